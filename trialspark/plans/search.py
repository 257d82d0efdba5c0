"""Resumable parameter search over the shared binned matrix.

The ledger is a written table: a row per proposed candidate (no fold) and one
per finished fit (candidate, fold, sum of squared errors, rows).  A search
reads it first, so after a restart finished fits are skipped, proposed
candidates are completed as proposed, and the next ones are proposed from the
scores so far.  Proposals depend on the ledger's rows and the seed alone.

The first candidates are seeded draws from the space.  Later ones come from
two kernel densities over the unit cube of the space: one around the better
quarter of the scored candidates, one around the others; of many draws from
the first, the one with the highest density ratio is proposed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators.boosting import Forest, TreeParams, fit_many

SCHEMA = "candidate int, params string, fold int, sse double, n double"
START = 5       # candidates drawn before any proposal learns
DRAWS = 64      # draws per proposal
WIDTH = 0.15    # of a kernel, in the unit cube


def draw(space: Mapping[str, tuple], rng: np.random.RandomState) -> dict:
    """One candidate: log-uniform or uniform in each range; integer bounds mean integers."""
    return from_unit(space, [rng.uniform() for _ in space])


def from_unit(space: Mapping[str, tuple], point: Sequence[float]) -> dict:
    out = {}
    for (name, (lo, hi, prior)), u in zip(space.items(), point):
        x = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))) if prior == "log-uniform" else lo + u * (hi - lo)
        if isinstance(lo, int) and isinstance(hi, int):
            x = int(min(max(round(x), lo), hi))
        out[name] = x
    return out


def to_unit(space: Mapping[str, tuple], candidate: Mapping) -> np.ndarray:
    out = []
    for name, (lo, hi, prior) in space.items():
        f = math.log if prior == "log-uniform" else float
        out.append((f(candidate[name]) - f(lo)) / (f(hi) - f(lo)) if hi > lo else 0.5)
    return np.array(out)


def _log_density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Mean of Gaussian kernels around the centres and one flat one."""
    d = ((x[:, None, :] - centres[None]) / WIDTH) ** 2
    kernels = np.exp(-0.5 * d.sum(2)) / (WIDTH * math.sqrt(2 * math.pi)) ** x.shape[1]
    return np.log((kernels.sum(1) + 1.0) / (len(centres) + 1))


def propose(space: Mapping[str, tuple], scored: Sequence[tuple[Mapping, float]], n: int, number: int, seed: int) -> list[dict]:
    """``n`` candidates, numbered from ``number``; ``scored`` are (candidate, mse) so far."""
    ranked = sorted(scored, key=lambda s: s[1])
    n_good = max(1, len(ranked) // 4)
    out = []
    for k in range(number, number + n):
        rng = np.random.RandomState([seed, k])
        if k < START or len(ranked) < START:
            out.append(draw(space, rng))
            continue
        good, bad = (np.array([to_unit(space, c) for c, _ in part]) for part in (ranked[:n_good], ranked[n_good:]))
        x = np.clip(good[rng.randint(len(good), size=DRAWS)] + rng.normal(scale=WIDTH, size=(DRAWS, len(space))), 0, 1)
        x[:DRAWS // 8] = rng.uniform(size=(DRAWS // 8, len(space)))  # some from anywhere
        out.append(from_unit(space, x[int(np.argmax(_log_density(x, good) - _log_density(x, bad)))]))
    return out


@dataclass
class Ledger:
    """The rows of a search at a path any executor can read; appended to, never rewritten."""

    spark: SparkSession
    path: str
    candidates: dict[int, dict] = field(default_factory=dict)
    scores: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path).collect()  # one row per fit
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        for r in rows:
            if r["fold"] is None:
                self.candidates[r["candidate"]] = json.loads(r["params"])
            else:
                self.scores[r["candidate"], r["fold"]] = r["sse"], r["n"]

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def propose(self, new: Sequence[Mapping]) -> None:
        at = len(self.candidates)
        self._append([(at + i, json.dumps(c, sort_keys=True), None, None, None) for i, c in enumerate(new)])
        self.candidates |= {at + i: dict(c) for i, c in enumerate(new)}

    def finish(self, scores: Mapping[tuple[int, int], tuple[float, float]]) -> None:
        self._append([(c, json.dumps(self.candidates[c], sort_keys=True), f, s, n) for (c, f), (s, n) in scores.items()])
        self.scores |= scores

    def mse(self, folds: Sequence[int]) -> dict[int, float]:
        """Mean over the folds of the fold's mean squared error, of the candidates that have all."""
        out = {}
        for c in self.candidates:
            own = [self.scores[c, f] for f in folds if (c, f) in self.scores]
            if len(own) == len(folds):
                per = [s / n for s, n in own if n > 0]
                out[c] = sum(per) / len(per) if per else float("inf")
        return out

    def table(self) -> DataFrame:
        """(candidate, params, fold, n, mse) of the finished fits."""
        return (self.spark.read.schema(SCHEMA).parquet(self.path).filter("fold is not null")
                .select("candidate", "params", "fold", "n", F.try_divide("sse", "n").alias("mse")))


def search(blocks: DataFrame, n_bins: np.ndarray, space: Mapping[str, tuple], n_iter: int, folds: Sequence[int],
           ledger: Ledger, batch: int = 4, seed: int = 0) -> tuple[dict, dict[int, float]]:
    """Score ``n_iter`` candidates on all folds; returns the best and the mse of each.

    A batch of candidates and all its folds are fitted in lockstep over the
    same blocks.  Ties go to the earlier candidate.
    """
    if n_iter < 1 or not folds:
        raise ValueError("a search needs a candidate and a fold")
    while True:
        missing = [(c, f) for c in ledger.candidates if c < n_iter for f in folds if (c, f) not in ledger.scores]
        if missing:
            specs = [(TreeParams.of(ledger.candidates[c], seed), f) for c, f in missing]
            fit_many(blocks, n_bins, specs,
                     finished=lambda done: ledger.finish({missing[k]: s for k, s in done.items()}))  # noqa: B023
            left = {m: (0.0, 0.0) for m in missing if m not in ledger.scores}
            if left:  # folds without a row
                ledger.finish(left)
        mse = ledger.mse(folds)
        if len(ledger.candidates) >= n_iter:
            mse = {c: m for c, m in mse.items() if c < n_iter}
            best = min(mse, key=lambda c: (mse[c], c))
            return ledger.candidates[best], mse
        known = len(ledger.candidates)
        ledger.propose(propose(space, [(ledger.candidates[c], m) for c, m in mse.items()],
                               min(batch, n_iter - known), known, seed))


def refit(blocks: DataFrame, n_bins: np.ndarray, candidate: Mapping, seed: int = 0) -> Forest:
    """The candidate on all rows."""
    return fit_many(blocks, n_bins, [(TreeParams.of(candidate, seed), None)])[0][0]
