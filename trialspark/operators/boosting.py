"""Boosted regression trees over the binned matrix, many fits in one pass.

Squared error, second order: a row's gradient is prediction - label and its
hessian 1.  Growing needs, per node, feature and bin, the sums of both:

1. every task sums its blocks of rows into one histogram per requested node
   (numpy, bounded by ``HIST_BYTES``),
2. the histograms of a node are shuffled together in chunks of features and
   added in a fixed order; the smaller child alone is summed from rows, its
   sibling is the parent's histogram less the child's,
3. the best split of each chunk goes to the driver: one row per node and chunk.

With G, H the sums, T(G) = sign(G) max(|G| - alpha, 0) and the score
T(G)^2 / (H + lambda), a split's gain is the children's scores less the
node's; it needs a gain of ``gamma`` and ``min_child_weight`` hessian on both
sides.  A NULL has no bin: each split is scored with the NULLs on either side
and keeps the better direction.  A leaf's value is -rate T(G) / (H + lambda).

Trees grow best gain first until ``num_leaves`` (or all splits, which is the
depth-wise tree).  A pass asks for the children of every node that the queue
would split on what is known so far, so a tree takes as many passes as it has
levels, and the final queue is replayed on complete knowledge.

All fits (candidates x folds) grow in lockstep: a pass serves the waiting
nodes of all of them, so a search costs about as many passes as its longest
fit.  Predictions so far are stored with the blocks and written anew every
``FLUSH`` trees; between, tasks apply the few new trees themselves.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators.binning import BLOCK_BYTES, MISSING, Bins, block_rows, code_rows, columns_of, to_matrix
from trialspark.session import LARGE_RECORDS, arrow_batches, drop_table, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLUSH = 16                  # trees between two writes of the predictions
CHUNK_BINS = 1 << 15        # bins of one shuffled histogram (two doubles each)
HIST_BYTES = 256 << 20      # histograms a task may hold at a time; more nodes wait for the next pass
JOINT_BINS = 1 << 12        # joint bins of features that are counted together, and over all nodes of a pass four times that
JOINT_BYTES = 64 << 20      # joint histograms a task may hold; beyond it fewer features are counted together
BATCH_BYTES = 16 << 20      # blocks or histograms handed to a task's Python at a time
SMALL_TREE = 64             # inner nodes up to which rows are placed node by node
TOP_NODES = 8               # inner nodes whose directions are looked up together, one bit of a byte each
PART_ROWS = 1 << 15         # rows of small blocks that are counted together
MAX_DEPTH = 60              # node ids are paths: 1 is the root, 2i and 2i + 1 the children of i
_EPS = 1e-10                # gains that differ by less than this share are ties: lowest feature, lowest cut


@dataclass(frozen=True)
class TreeParams:
    """One candidate; every parameter acts on the fit."""

    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    num_leaves: int | None = None     # None: no limit
    min_child_weight: float = 1.0     # hessian a child needs
    min_child_samples: int = 1        # rows a child needs
    subsample: float = 1.0            # share of the rows a tree is grown on
    colsample_bytree: float = 1.0     # share of the features a tree may use
    gamma: float = 0.0                # gain a split needs
    reg_alpha: float = 0.0            # L1 on leaf sums
    reg_lambda: float = 1.0           # L2 on leaf values
    seed: int = 0

    @classmethod
    def of(cls, candidate: Mapping, seed: int = 0) -> TreeParams:
        unknown = set(candidate) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"parameters without a meaning here: {sorted(unknown)}")
        return cls(**{**candidate, "seed": seed})

    def __post_init__(self):
        if not 1 <= self.max_depth <= MAX_DEPTH:
            raise ValueError(f"max_depth must be from 1 to {MAX_DEPTH}")
        if self.num_leaves is not None and self.num_leaves < 1:
            raise ValueError("num_leaves must be positive")

    @property
    def child_weight(self) -> float:
        return max(self.min_child_weight, self.min_child_samples)  # one hessian a row


@dataclass
class Tree:
    """Nodes by place: a leaf has ``left`` -1; codes up to ``cut`` go left, NULLs where ``null_left`` says."""

    feature: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    ids: np.ndarray | None = None  # paths, while growing
    ends: tuple | None = field(default=None, repr=False, compare=False)  # of the first nodes, once looked up

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node each row (column of ``codes``) ends in."""
        n = codes.shape[1]
        if np.count_nonzero(self.left >= 0) <= SMALL_TREE:
            return self._place_by_node(codes)
        at, rows = np.zeros(n, np.int32), np.arange(n)
        while len(rows):
            here = at[rows]
            inner = self.left[here] >= 0
            rows, here = rows[inner], here[inner]
            if not len(rows):
                break
            code = codes[self.feature[here], rows]
            goes = np.where(code == MISSING, self.null_left[here], code <= self.cut[here])
            at[rows] = np.where(goes, self.left[here], self.right[here])
        return at

    def _place_by_node(self, codes: np.ndarray) -> np.ndarray:
        """``place`` with one comparison of bytes for every inner node; the first few are looked up together."""
        if self.ends is None:
            self.ends = self._top()
        top, ends = self.ends
        bits = np.zeros(codes.shape[1], np.uint8)
        for k, i in enumerate(top):
            bits |= self._goes_left(i, codes).view(np.uint8) << np.uint8(k)
        at = ends[bits]
        todo = [(i, at == i) for i in np.unique(ends) if self.left[i] >= 0]
        for i, here in todo:
            at[here] = 0
        while todo:
            i, here = todo.pop()
            if self.left[i] < 0:
                at |= here.view(np.uint8) * np.uint8(i)
                continue
            goes = self._goes_left(i, codes)
            todo += [(self.left[i], here & goes), (self.right[i], here > goes)]
        return at

    def _goes_left(self, i: int, codes: np.ndarray) -> np.ndarray:
        code, cut = codes[self.feature[i]], int(self.cut[i])
        # one more turns the code of a NULL, the highest byte, into the lowest
        return code + np.uint8(1) <= cut + 1 if self.null_left[i] else code <= cut

    def _top(self) -> tuple[list[int], np.ndarray]:
        """The first ``TOP_NODES`` inner nodes from the root, and for each set of their directions the node it ends in."""
        top, todo = [], [0]
        while todo and len(top) < TOP_NODES:
            i = todo.pop(0)
            if self.left[i] >= 0:
                top.append(i)
                todo += [self.left[i], self.right[i]]
        sets = np.arange(1 << len(top))
        ends = np.zeros(len(sets), np.uint8)
        for k, i in enumerate(top):  # a node comes after its parent
            goes = np.where(sets >> k & 1, self.left[i], self.right[i])
            ends = np.where(ends == i, goes, ends).astype(np.uint8)
        return top, ends


@dataclass
class Forest:
    """A fitted model: base + sum of the trees."""

    base: float
    trees: list[Tree]
    params: TreeParams

    def predict_codes(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(codes.shape[1], self.base)
        for t in self.trees:
            out += t.value[t.place(codes)]
        return out


@dataclass
class _Node:
    depth: int
    g: float
    h: float
    split: tuple | None = None   # (gain, feature, cut, null_left, gl, hl)
    known: bool = False          # its histogram was looked through
    made: int = -1               # pass that made its histogram


@dataclass
class _Fit:
    """A fit's progress on the driver."""

    index: int
    params: TreeParams
    held_out: int | None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    flushed: int = 0
    nodes: dict[int, _Node] = field(default_factory=dict)
    features: np.ndarray | None = None
    waiting: list[int] = field(default_factory=list)  # nodes to split whose children's histograms are needed

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.params.n_estimators

    def start_tree(self, n_features: int) -> None:
        k = max(1, round(self.params.colsample_bytree * n_features))
        rng = np.random.RandomState([self.params.seed, len(self.trees)])
        self.features = np.sort(rng.choice(n_features, k, replace=False)) if k < n_features else np.arange(n_features)
        self.nodes, self.waiting = {1: _Node(0, 0.0, 0.0)}, [0]  # 0 stands above the root

    def replay(self) -> list[int]:
        """Split best gain first on what is known; returns the split nodes in order and fills ``waiting``."""
        limit = self.params.num_leaves or float("inf")
        heap, order, self.waiting = [], [], []
        self._push(heap, 1)
        while heap and len(order) + 1 < limit:
            _, i = heapq.heappop(heap)
            order.append(i)
            if self.nodes[i].depth + 1 >= self.params.max_depth:
                continue  # its children are leaves
            if 2 * i not in self.nodes:
                self.waiting.append(i)
                continue
            self._push(heap, 2 * i)
            self._push(heap, 2 * i + 1)
        return order

    def split_nodes(self) -> list[int]:
        """Nodes whose children are known."""
        return [i for i in self.nodes if 2 * i in self.nodes]

    def _push(self, heap: list, i: int) -> None:
        if self.nodes[i].split:
            heapq.heappush(heap, (-self.nodes[i].split[0], i))

    def tree(self, order: Sequence[int], with_ids: bool = False) -> Tree:
        """The tree that splits the nodes of ``order`` and no others."""
        p, splits = self.params, set(order)
        ids, sums = [1], {1: (self.nodes[1].g, self.nodes[1].h)}
        for i in ids:
            if i in splits:
                _, _, _, _, gl, hl = self.nodes[i].split
                g, h = sums[i]
                sums[2 * i], sums[2 * i + 1] = (gl, hl), (g - gl, h - hl)
                ids += [2 * i, 2 * i + 1]
        at = {i: k for k, i in enumerate(ids)}
        cut = [self.nodes[i].split if i in splits else (0, 0, 0, False) for i in ids]
        value = [0.0 if i in splits or sums[i][1] <= 0 else
                 float(-p.learning_rate * shrink(sums[i][0], p.reg_alpha) / (sums[i][1] + p.reg_lambda)) for i in ids]
        return Tree(np.array([c[1] for c in cut], np.int64), np.array([c[2] for c in cut], np.int64),
                    np.array([bool(c[3]) for c in cut]),
                    np.array([at[2 * i] if i in splits else -1 for i in ids], np.int32),
                    np.array([at[2 * i + 1] if i in splits else -1 for i in ids], np.int32), np.array(value),
                    np.array(ids, np.int64) if with_ids else None)


def shrink(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _kept(seed: int, tree: int, block: int, n: int, share: float) -> np.ndarray:
    """Which rows of a block a tree is grown on: a hash of seed, tree, block and row, so a retried task agrees."""
    with np.errstate(over="ignore"):
        h = (np.arange(n, dtype=np.uint64) + np.uint64(block) * np.uint64(0x9E3779B97F4A7C15)
             + np.uint64(seed) * np.uint64(0xD1342543DE82EF95) + np.uint64(tree) * np.uint64(0xAF251AF3B0F025B5))
        for k in (30, 27):
            h = (h ^ (h >> np.uint64(k))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < share


def _layout(features: np.ndarray, n_bins: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each feature's first slot (values, then one for NULL), and the chunks of features."""
    first = np.concatenate(([0], np.cumsum(n_bins[features] + 1)))
    chunks, begin = [], 0
    while begin < len(features):
        end = int(np.searchsorted(first, first[begin] + CHUNK_BINS, side="right")) - 1
        end = min(max(end, begin + 1), len(features))
        chunks.append((begin, end))
        begin = end
    return first, chunks


def best_split(g: np.ndarray, h: np.ndarray, features: np.ndarray, n_bins: np.ndarray,
               p: TreeParams) -> tuple[float, float, tuple | None]:
    """Sums of a node and its best split from the histograms of some features (slots as in ``_layout``)."""
    sizes = n_bins[features] + 1
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    total_g, total_h = float(g[:sizes[0]].sum()), float(h[:sizes[0]].sum())
    cg, ch = np.cumsum(g), np.cumsum(h)
    before = np.repeat(first, sizes)
    cg, ch = cg - (cg[before] - g[before]), ch - (ch[before] - h[before])  # sums from the feature's first slot
    null = np.repeat(first + sizes - 1, sizes)
    is_value = np.ones(len(g), bool)
    is_value[first + sizes - 1] = False
    score = lambda a, b: shrink(a, p.reg_alpha) ** 2 / np.maximum(b + p.reg_lambda, 1e-300)
    own = score(total_g, total_h)
    gains = []
    for gl, hl in ((cg, ch), (cg + g[null], ch + h[null])):  # NULLs right, NULLs left
        hr = total_h - hl
        ok = is_value & (hl > 0.5) & (hr > 0.5) & (hl >= p.child_weight) & (hr >= p.child_weight)
        gains.append(np.where(ok, score(gl, hl) + score(total_g - gl, hr) - own, -np.inf))
    gain = np.maximum(*gains)
    top = gain.max() if len(gain) else -np.inf
    if not top > max(p.gamma, 1e-12 * max(own, 1.0)):  # no gain but rounding is none
        return total_g, total_h, None
    k = int(np.argmax(gain >= top * (1 - _EPS)))
    left = bool(gains[1][k] > gains[0][k] * (1 + _EPS))
    f = int(np.searchsorted(first, k, side="right")) - 1
    return total_g, total_h, (float(gain[k]), int(features[f]), int(k - first[f]), left,
                              float(cg[k] + left * g[null[k]]), float(ch[k] + left * h[null[k]]))


@dataclass
class _Ask:
    """What a pass wants of one fit: histograms of ``nodes`` (paths) of the tree so far."""

    fit: int
    params: TreeParams
    held_out: int | None
    number: int               # of the tree
    new: list[Tree]           # trees since the last write
    tree: Tree
    features: np.ndarray
    nodes: list[int]          # whose rows are summed
    parents: dict[int, int]   # node -> pass that made its parent's histogram


def _predicted(row_margins: np.ndarray, new: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    out = row_margins.copy()
    for t in new:
        out += t.value[t.place(codes)]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], n_fits: int):
    """Unpacked blocks: (block, labels, folds, codes, margins)."""
    for batch in batches:
        cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            n = cols["n"][k].as_py()
            get = lambda c, t: np.frombuffer(cols[c][k].as_buffer(), t)  # noqa: E731, B023
            margins = get("margins", "<f8").reshape(n_fits, n) if "margins" in cols else None
            yield (cols["block"][k].as_py(), get("label", "<f8"), get("fold", "<i2"),
                   get("bins", np.uint8).reshape(-1, n), margins)


def _bundles(features: np.ndarray, n_bins: np.ndarray, n_nodes: int, room: int = JOINT_BYTES) -> list[tuple[int, int]]:
    """Neighbouring features that are counted together, as (begin, end): few joint bins, within ``room`` bytes.

    Features of few values (markers) share one pass over the rows; a feature of many is alone.
    """
    sizes = (n_bins[features] + 1).tolist()
    most = min(JOINT_BINS, 4 * JOINT_BINS // max(n_nodes, 1))
    while True:
        out, begin, joint, total = [], 0, 1, 0
        for f, size in enumerate(sizes):
            if f > begin and joint * size > most:
                out.append((begin, f))
                total, begin, joint = total + joint, f, 1
            joint *= size
        out.append((begin, len(sizes)))
        if 16 * n_nodes * (total + joint) <= room or most == 0:
            return out
        most = most // 4 if most > 16 else 0


def _parts(batches: Iterator[pa.RecordBatch], n_fits: int):
    """Blocks as ``_blocks`` gives them, small ones side by side: (numbers and rows of the blocks, labels, folds, codes, margins).

    A part has at most ``PART_ROWS`` rows and ``BLOCK_BYTES`` of codes, or is one block.
    """
    held, n = [], 0
    for block, label, fold, codes, margins in _blocks(batches, n_fits):
        rows = len(label)
        if held and (n + rows > PART_ROWS or (n + rows) * len(codes) > BLOCK_BYTES):
            yield _side_by_side(held)
            held, n = [], 0
        held.append(((block, rows), label, fold, codes, margins))
        n += rows
    if held:
        yield _side_by_side(held)


def _side_by_side(held: list):
    blocks, *columns = zip(*held)
    return [blocks, *(c[0] if len(c) == 1 else np.concatenate(c, axis=-1) for c in columns)]


def _joint_codes(codes, features, n_bins, bundles) -> list[np.ndarray]:
    """The joint bin of each row in each bundle."""
    out = []
    for b, e in bundles:
        at = None
        for f in features[b:e]:
            code = np.minimum(codes[f], np.uint8(n_bins[f])).astype(np.uint16)  # a NULL's slot follows the values'
            at = code if at is None else at * np.uint16(n_bins[f] + 1) + code
        out.append(at)
    return out


def _joint_sums(held, codes, grad, slot, n_nodes, features, n_bins, bundles, joint=None):
    """Add rows to the joint histograms of each bundle (nodes x joint bins): rows with ``slot`` >= 0 count."""
    sizes = [int(np.prod(n_bins[features[b:e]] + 1)) for b, e in bundles]
    if held is None:
        held = [(np.zeros(n_nodes * size), np.zeros(n_nodes * size, np.int64)) for size in sizes]
    rows = np.flatnonzero(slot >= 0)
    if not len(rows):
        return held
    grad, node = grad[rows], slot[rows].astype(np.intp)
    for at, size, (g, h) in zip(joint or _joint_codes(codes, features, n_bins, bundles), sizes, held):
        at = at[rows].astype(np.intp)
        if n_nodes > 1:
            at += node * size
        g += np.bincount(at, grad, len(g))
        h += np.bincount(at, minlength=len(h))
    return held


def _single_sums(held, n_nodes, features, n_bins, bundles) -> tuple[np.ndarray, np.ndarray]:
    """The histograms of each feature, side by side (nodes x slots), from the joint ones."""
    out = []
    for k in (0, 1):
        parts = []
        for (b, e), sums in zip(bundles, held):
            joint = sums[k].reshape(n_nodes, *(n_bins[features[b:e]] + 1))
            axes = range(1, joint.ndim)
            parts += [joint.sum(axis=tuple(x for x in axes if x != keep)) for keep in axes]
        out.append(np.concatenate(parts, axis=1).astype(np.float64))
    return out[0], out[1]


_HIST = "fit int, parent bigint, part int, chunk int, task int, g binary, h binary"
_BEST = ("fit int, node bigint, chunk int, g binary, h binary, sum_g double, sum_h double, gain double, feature int, "
         "cut int, null_left boolean, gl double, hl double")


def _histograms(state: DataFrame, asks: Sequence[_Ask], n_bins: np.ndarray, n_fits: int) -> DataFrame:
    """One row per task, asked node and chunk: the sums over the task's rows."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        layouts = [_layout(a.features, n_bins) for a in asks]
        # fits on the same features share the joint bins, fits of one sample the choice of its rows
        alike: dict = {}
        for k, a in enumerate(asks):
            alike.setdefault(a.features.tobytes(), []).append(k)
        bundles: list = [None] * len(asks)
        for ks in alike.values():
            most = max(len(asks[k].nodes) for k in ks)
            found = _bundles(asks[ks[0]].features, n_bins, most, JOINT_BYTES // len(asks))
            for k in ks:
                bundles[k] = found
        held: list = [None] * len(asks)
        for blocks, label, fold, codes, margins in _parts(batches, n_fits):
            samples: dict = {}
            for ks in alike.values():
                joint = _joint_codes(codes, asks[ks[0]].features, n_bins, bundles[ks[0]])
                for k in ks:
                    a = asks[k]
                    grad = _predicted(margins[a.fit], a.new, codes) - label
                    where = np.full(len(a.tree.ids), -1, np.int32)
                    for s, node in enumerate(a.nodes):
                        where[a.tree.ids == node] = s
                    slot = where[a.tree.place(codes)]
                    if a.held_out is not None:
                        slot = np.where(fold == a.held_out, -1, slot)
                    if a.params.subsample < 1:
                        sample = a.params.seed, a.number, a.params.subsample
                        if sample not in samples:
                            samples[sample] = np.concatenate([_kept(a.params.seed, a.number, block, n, a.params.subsample)
                                                              for block, n in blocks])
                        slot = np.where(samples[sample], slot, -1)
                    held[k] = _joint_sums(held[k], codes, grad, slot, len(a.nodes), a.features, n_bins, bundles[k], joint)
        for k, a in enumerate(asks):
            if not held[k]:
                continue
            first, chunks = layouts[k]
            g, h = _single_sums(held[k], len(a.nodes), a.features, n_bins, bundles[k])
            for s, node in enumerate(a.nodes):
                for c, (begin, end) in enumerate(chunks):
                    some = slice(first[begin], first[end])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a.fit], pa.int32()), pa.array([node >> 1]), pa.array([node & 1], pa.int32()),
                         pa.array([c], pa.int32()), pa.array([task], pa.int32()), pa.array([g[s, some].tobytes()]),
                         pa.array([h[s, some].tobytes()])], ["fit", "parent", "part", "chunk", "task", "g", "h"])

    return state.mapInArrow(sums, _HIST)


def _merged(rows: DataFrame, asks: Sequence[_Ask], n_bins: np.ndarray, one_task: bool = False) -> DataFrame:
    """Add the histograms of each node, derive the sibling's, and find the best split of each chunk.

    Histograms that all come from one task are not shuffled.
    """
    by_fit = {a.fit: a for a in asks}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key, parent, child):
            fit, above, chunk = key
            a = by_fit[fit]
            begin, end = _layout(a.features, n_bins)[1][chunk]
            nodes = [(2 * above + side, child) for side in [child[2]]]
            if parent is not None:
                nodes.append((2 * above + 1 - child[2], (parent[0] - child[0], np.round(parent[1] - child[1]))))
            out = []
            for node, s in nodes:
                total_g, total_h, split = best_split(s[0], s[1], a.features[begin:end], n_bins, a.params)
                out.append((fit, node, chunk, s[0].tobytes(), s[1].tobytes(), total_g, total_h,
                            *(split or [None] * 6)))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), _BEST_TYPES)], _BEST_NAMES)

        now = parent = child = None
        for batch in batches:
            for fit, above, part, chunk, _, g, h in zip(*(c.to_pylist() for c in batch.columns)):
                key = (fit, above, chunk)
                if key != now and child is not None:
                    yield found(now, parent, child)
                if key != now:
                    now, parent, child = key, None, None
                g, h = np.frombuffer(g, "<f8"), np.frombuffer(h, "<f8")
                if part < 0:
                    parent = (g, h)
                else:
                    child = (g, h, part) if child is None else (child[0] + g, child[1] + h, part)
        if child is not None:
            yield found(now, parent, child)

    key = ["fit", "parent", "chunk"]
    n_keys = sum(len(a.nodes) * len(_layout(a.features, n_bins)[1]) for a in asks)
    parts = max(1, min(n_keys, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.coalesce(1) if one_task else rows.repartition(parts, *key)
    return rows.sortWithinPartitions(*key, "part", "task").mapInArrow(merge, _BEST)


_BEST_NAMES = [c.split()[0] for c in _BEST.split(", ")]
_BEST_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(),
               pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64()]


def _pick(rows: Sequence) -> tuple | None:
    """The best split of a node over its chunks, by the same rule as within one."""
    splits = sorted((r["feature"], r["cut"], r) for r in rows if r["gain"] is not None)
    if not splits:
        return None
    top = max(r["gain"] for _, _, r in splits)
    r = next(r for _, _, r in splits if r["gain"] >= top * (1 - _EPS))
    return r["gain"], r["feature"], r["cut"], r["null_left"], r["gl"], r["hl"]


def fit_many(blocks: DataFrame, n_bins: np.ndarray, specs: Sequence[tuple[TreeParams, int | None]], flush: int = FLUSH,
             finished: Callable[[dict[int, tuple[float, float]]], None] | None = None
             ) -> tuple[list[Forest], list[tuple[float, float] | None]]:
    """Fit every (parameters, held-out fold or None) on the written blocks of ``binned_blocks``.

    Returns the models and, for fits with a held-out fold, (sum of squared
    errors, rows) of that fold.  ``finished`` is called with the scores of
    fits as they complete, at every write of the predictions.  A fold or a
    table without rows gives models of no trees.
    """
    # a record is a block of rows or a histogram: few of them make a batch, however many a task gets
    record = max(block_rows(len(n_bins)) * (len(n_bins) + 10 + 8 * len(specs)), 16 * CHUNK_BINS)
    with _fixed_plans(blocks.sparkSession), arrow_batches(blocks.sparkSession, BATCH_BYTES // record):
        return _fit_many(blocks, n_bins, specs, flush, finished)


@contextmanager
def _fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Two-stage passes whose partitions are chosen here: planning them anew at run time only adds jobs."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _fit_many(blocks, n_bins, specs, flush, finished):
    base, n_rows = _bases(blocks, specs)
    fits = [_Fit(k, p, held, b) for k, ((p, held), b) in enumerate(zip(specs, base))]
    scores: list = [None] * len(fits)
    told: set[int] = set()
    # every core has its share of the blocks, and a task works through some megabytes of codes at least
    tasks = max(1, -(-n_rows * (len(n_bins) + 8 * len(fits)) // BLOCK_BYTES))
    tasks = min(tasks, blocks.sparkSession.sparkContext.defaultParallelism)
    state = _with_margins(blocks.coalesce(1) if tasks == 1 else blocks.repartition(tasks), fits)
    retired: list[tuple[int, DataFrame]] = []
    passes: dict[int, DataFrame] = {}  # cached histograms by pass, while a growing tree may need them
    number = 0

    def tell():
        ready = [f.index for f in fits if f.done and f.flushed == len(f.trees) and f.index not in told]
        if ready:
            for k, s in _scores(state, fits, ready).items():
                scores[k] = s
            told.update(ready)
            if finished:
                finished({k: scores[k] for k in ready if scores[k] is not None})

    for f in fits:
        if f.base is None:
            f.base, f.params = 0.0, replace(f.params, n_estimators=0)
    while True:
        for f in fits:
            if not f.done and not f.nodes:
                f.start_tree(len(n_bins))
        asks = _asks(fits, n_bins)
        if not asks:
            break
        number += 1
        rows = _histograms(state, asks, n_bins, len(fits))
        for past in sorted({m for a in asks for m in a.parents.values() if m >= 0}):
            wanted = [f"{a.fit}:{n >> 1}" for a in asks for n, m in a.parents.items() if m == past]
            rows = rows.unionByName(passes[past].filter(F.concat_ws(":", "fit", "node").isin(wanted)).select(
                "fit", F.col("node").alias("parent"), F.lit(-1).alias("part"), "chunk", F.lit(-1).alias("task"), "g", "h"))
        best = _merged(rows, asks, n_bins, tasks == 1)
        if any(n.bit_length() < a.params.max_depth for a in asks for n in a.nodes):
            best = passes[number] = best.persist()  # children may be derived from these
        by_node: dict = {}
        for r in best.drop("g", "h").collect():  # one row per asked node, its sibling and chunk
            by_node.setdefault((r["fit"], r["node"]), []).append(r)
        for (k, i), found in by_node.items():
            f = fits[k]
            node = f.nodes.setdefault(i, _Node(i.bit_length() - 1, 0.0, 0.0))
            r = min(found, key=lambda r: r["chunk"])
            node.g, node.h, node.split, node.known, node.made = r["sum_g"], r["sum_h"], _pick(found), True, number
        for a in asks:
            f = fits[a.fit]
            if not f.nodes[1].known:  # no row of this tree's sample
                f.nodes[1].known = True
            order = f.replay()
            if not f.waiting:
                f.trees.append(f.tree(order))
                f.nodes = {}
        live = {n.made for f in fits for n in f.nodes.values()}
        for m in [m for m in passes if m not in live]:
            passes.pop(m).unpersist()
        if max(len(f.trees) - f.flushed for f in fits) >= flush:
            retired.append((number, state))
            state = _flushed(state, fits)
            tell()
        # cached histograms may have to be summed again from the table they came from
        for at, table in [r for r in retired if not passes or min(passes) > r[0]]:
            retired.remove((at, table))
            drop_table(table.unpersist())
    for df in passes.values():
        df.unpersist()
    if any(f.flushed < len(f.trees) for f in fits):
        retired.append((number, state))
        state = _flushed(state, fits)
    tell()
    for table in [t for _, t in retired] + [state]:
        drop_table(table.unpersist())
    return [Forest(f.base, f.trees, f.params) for f in fits], scores


def _asks(fits: Sequence[_Fit], n_bins: np.ndarray) -> list[_Ask]:
    """The waiting nodes of all fits, as many as the histograms' bound allows (one at least)."""
    out, room = [], HIST_BYTES
    for f in fits:
        if f.done or not f.nodes:
            continue
        cost = 16 * int((n_bins[f.features] + 1).sum())
        if f.waiting == [0]:
            tree, nodes, parents = f.tree([], with_ids=True), [1], {1: -1}
        else:
            tree = f.tree(sorted(set(f.split_nodes()) | set(f.waiting)), with_ids=True)
            nodes, parents = [], {}
            for i in f.waiting:
                h, hl = f.nodes[i].h, f.nodes[i].split[5]
                small = 2 * i if hl <= h - hl else 2 * i + 1
                nodes.append(small)
                parents[small] = f.nodes[i].made
        fits_in = max(room // cost, 0 if out else 1)
        if not fits_in:
            break
        nodes = nodes[:fits_in]
        out.append(_Ask(f.index, f.params, f.held_out, len(f.trees), f.trees[f.flushed:], tree, f.features, nodes,
                        {n: parents[n] for n in nodes}))
        room -= cost * len(nodes)
    return out


def _bases(blocks: DataFrame, specs) -> tuple[list, int]:
    """Mean label of each fit's own rows (None without rows), and the number of all rows."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for _, label, fold, _, _ in _blocks(batches, 0):
            for k in np.unique(fold):
                y = label[fold == k]
                s, n = out.get(int(k), (0.0, 0))
                out[int(k)] = s + float(y.sum()), n + len(y)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([s for s, _ in out.values()]),
                                              pa.array([n for _, n in out.values()])], ["fold", "s", "n"])

    rows = (blocks.select("block", "n", "label", "fold", "bins").mapInArrow(sums, "fold int, s double, n bigint")
            .groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())  # one row per fold
    out = []
    for _, held in specs:
        own = [r for r in rows if r["fold"] != held]
        n = sum(r["n"] for r in own)
        out.append(sum(r["s"] for r in sorted(own, key=lambda r: r["fold"])) / n if n else None)
    return out, sum(r["n"] for r in rows)


def _with_margins(blocks: DataFrame, fits: Sequence[_Fit]) -> DataFrame:
    bases = np.array([f.base if f.base is not None else 0.0 for f in fits])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [np.repeat(bases, n).astype("<f8").tobytes() for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m, pa.binary())], [*batch.schema.names, "margins"])

    cols = blocks.select("block", "n", "label", "fold", "bins")
    return _kept_state(cols.mapInArrow(add, _STATE))


def _kept_state(df: DataFrame) -> DataFrame:
    """Written, and kept in the executors (on their disks beyond their memory), as every pass reads it."""
    return materialize(df, "boosting_state", LARGE_RECORDS).persist()


_STATE = "block bigint, n bigint, label binary, fold binary, bins binary, margins binary"


def _flushed(state: DataFrame, fits: Sequence[_Fit]) -> DataFrame:
    """Write the blocks with the predictions of all trees so far."""
    new = [f.trees[f.flushed:] for f in fits]
    n_fits = len(fits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [np.stack([_predicted(margins[k], new[k], codes) for k in range(n_fits)]).astype("<f8").tobytes()
                 for _, _, _, codes, margins in _blocks([batch], n_fits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(m, pa.binary())], batch.schema.names)

    out = _kept_state(state.mapInArrow(apply, _STATE))
    for f in fits:
        f.flushed = len(f.trees)
    return out


def _scores(state: DataFrame, fits: Sequence[_Fit], which: Sequence[int]) -> dict[int, tuple[float, float]]:
    """(sum of squared errors, rows) of the held-out fold of each of these fits."""
    held = {k: fits[k].held_out for k in which if fits[k].held_out is not None}
    if not held:
        return {}
    n_fits = len(fits)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, 0] for k in held}
        for _, label, fold, _, margins in _blocks(batches, n_fits):
            for k, fo in held.items():
                d = (margins[k] - label)[fold == fo]
                sums[k][0] += float((d * d).sum())
                sums[k][1] += len(d)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()]),
                                          pa.array([n for _, n in sums.values()])], ["fit", "s", "n"])

    rows = (state.mapInArrow(errors, "fit int, s double, n bigint").groupBy("fit")
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())  # one row per fit
    return {r["fit"]: (r["s"], float(r["n"])) for r in rows}


def predict(df: DataFrame, model: Forest, bins: Bins, out: str = "prediction") -> DataFrame:
    """``df`` with ``out``: each row's prediction from its own values, NULLs sent where the splits learned.

    The model travels with the tasks; its size is bounded by its parameters (trees x leaves).
    """
    n_scalars, array_len, cuts = len(bins.scalars), bins.array_len, bins.cuts
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    n_keep = len(keep)
    wide = df.select(*keep, *columns_of(df, bins.scalars, bins.array_col))
    schema = df.select(*keep).withColumn(out, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = code_rows(to_matrix(batch.columns[n_keep:], n_scalars, array_len), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(model.predict_codes(codes))],
                                             schema.names)

    return wide.mapInArrow(score, schema)


def write_model(spark: SparkSession, model: Forest, path: str) -> None:
    """The trees as a table (tree, node, feature, cut, null_left, left, right, value); tree -1 holds the base."""
    rows = [(-1, 0, 0, 0, False, -1, -1, model.base)]
    for k, t in enumerate(model.trees):
        rows += [(k, i, int(t.feature[i]), int(t.cut[i]), bool(t.null_left[i]), int(t.left[i]), int(t.right[i]),
                  float(t.value[i])) for i in range(len(t.value))]
    schema = "tree int, node int, feature int, cut int, null_left boolean, left int, right int, value double"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str, params: TreeParams | None = None) -> Forest:
    rows = spark.read.parquet(path).orderBy("tree", "node").collect()  # a model, bounded by its parameters
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(r)
    base = trees.pop(-1)[0]["value"]
    built = [Tree(np.array([r["feature"] for r in t], np.int64), np.array([r["cut"] for r in t], np.int64),
                  np.array([r["null_left"] for r in t]), np.array([r["left"] for r in t], np.int32),
                  np.array([r["right"] for r in t], np.int32), np.array([r["value"] for r in t])) for t in trees.values()]
    return Forest(base, built, params or TreeParams())
