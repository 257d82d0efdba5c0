"""Mixing to target weights with soft domain membership.

1. A naive Bayes classifier learns from a bounded sample of the
   labelled rows (``SAMPLE`` ids, the smallest by hash) in how many documents
   of each domain a feature occurs.  Features are the hashes of a text's
   distinct tokens (words, and runs of other signs) and the tenth its share
   of distinct tokens falls into; those that deviate clearly from chance, and
   by as much at any sample size, stay.
   Every fifth sample row is held back from it and calibrates: a document's
   mean evidence is scaled by one factor and shifted by one bias a domain,
   fitted to the held-back labels by Newton steps of multinomial logistic
   regression.  At its optimum the mean posterior of a domain over the
   held-back documents is the domain's share of their labels.
2. Every document gets a nonnegative rate (expected number of copies).  The
   expected tokens of a domain are the sum of rate x tokens x posterior.  The
   rates minimise the squared errors of these totals against the targets plus
   a slight pull towards rate one, by projected gradient descent: a step moves
   each rate along its posteriors by the domains' errors, preconditioned with
   the domains' Gram matrix over documents with a positive rate, and the rate
   is projected to zero or more.  The steps add up in one multiplier per
   domain, so a document's rate is ``max(0, 1 - posteriors . multipliers)`` at
   any time: a step is one pass over the written posteriors that returns a few
   sums, and nothing per document is rewritten.

All of it is DataFrame aggregation; the evidence table has at most one row per
hash bucket, a fixed number, and is all that is broadcast besides the sample's
ids.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, row_key
from trialspark.llm.decontaminate import once
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

BUCKETS = 1 << 16
SAMPLE = 20_000
HOLD_BACK = 5     # every fifth labelled row calibrates
RIDGE = 1e-3      # of the calibration's factor and biases, in rows
# of a feature that counts: documents, deviation from chance, correlation with a domain, likelihood ratio
MIN_DOCS, MIN_Z, MIN_PHI, MIN_LIFT = 5, 6.0, 0.15, 2.0
STEPS = 30
TOLERANCE = 1e-6  # of the wanted tokens
PULL = 1e-4       # of the rates towards one
#: Target token shares of the registered query, and the domain whose total stays as it is.
TARGETS = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
ANCHOR = "good"


def label_domain(quality: Column, toxic: Column) -> Column:
    """toxic, good or poor; null without a label."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _features(text: Column) -> Column:
    """struct<tokens, of>: the number of tokens, and the distinct features (buckets, then tenths)."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), 0)

    def described(t: Column) -> Column:
        buckets = F.array_distinct(F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
        tenth = F.floor(10 * F.size(buckets) / F.greatest(F.size(t), F.lit(1))).cast("int") + BUCKETS
        return once(buckets, lambda b: F.struct(
            F.size(t).cast("long").alias("tokens"),
            F.when(F.size(t) >= 10, F.array_append(b, tenth)).otherwise(b).alias("of")))

    return once(tokens, described)


def evidence(docs: DataFrame, labelled: DataFrame, domains: list[str],
             sample: int = SAMPLE) -> tuple[DataFrame, list[float], DataFrame]:
    """((feature, w0, w1, ...) log-likelihood ratios to the average, log priors, held-back (domain, of) rows).

    From (doc, text) and (id, domain) rows; ``of`` are a document's features.
    """
    chosen = materialize(labelled.orderBy(F.xxhash64("id"), "id").limit(sample), "label_sample")
    # at most ``sample`` rows of two short columns
    seen = docs.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select(
        "domain", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HOLD_BACK)) == 0).alias("held"), _features(F.col("text")).alias("f"))
    seen = materialize(seen.select("domain", "held", F.col("f.of").alias("of")), "label_features")  # one row per document
    held, seen = seen.filter("held"), seen.filter("not held")
    k = range(len(domains))
    each = [F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)]
    rows = seen.agg(*each).first()
    total = sum(rows)
    counts = (seen.select("domain", F.explode("of").alias("feature")).groupBy("feature")
              .agg(F.count(F.lit(1)).alias("c"), *each))
    share = F.col("c") / F.lit(float(max(total, 1)))

    def z(i: int) -> Column:
        mean = share * float(rows[i])
        spread = mean * (1 - share) * (1 - rows[i] / max(total, 1))
        return F.abs(F.col(f"c{i}") - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))

    weights = [F.log((F.col(f"c{i}") + share) / (float(rows[i]) + 1)) - F.log(share) for i in k]
    most = lambda xs: F.greatest(F.lit(0.0), *xs)
    kept = counts.filter(F.col("c") >= MIN_DOCS).filter(most([z(i) for i in k]) >= max(MIN_Z, MIN_PHI * math.sqrt(total))).select(
        "feature", *[w.alias(f"w{i}") for i, w in enumerate(weights)])
    kept = kept.filter(most([F.abs(F.col(f"w{i}")) for i in k]) >= math.log(MIN_LIFT))
    return materialize(kept, "evidence"), [math.log((r + 1) / (total + len(domains))) for r in rows], held


def mean_evidence(rows: DataFrame, weights: DataFrame, kept: list[str], n: int) -> DataFrame:
    """(``kept``, m0, m1, ...): the mean evidence for each of ``n`` domains over the features ``of``; zero without any."""
    flat = (rows.select(F.monotonically_increasing_id().alias("row"), *kept, "of")
            .select("row", *kept, F.explode_outer("of").alias("feature")))
    return (flat.join(F.broadcast(weights), "feature", "left")  # at most BUCKETS + 11 rows
            .groupBy("row", *kept).agg(*[F.coalesce(F.avg(f"w{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(n)])
            .drop("row"))


def _softmax(z: list[Column]) -> list[Column]:
    """Normalised exponentials of the columns, safe for large ones."""
    top = F.greatest(*z) if len(z) > 1 else z[0]
    total = sum((F.exp(x - top) for x in z), F.lit(0.0))
    return [F.exp(x - top) / total for x in z]


def calibrate(held: DataFrame, priors: list[float], domains: list[str], steps: int = 25) -> tuple[float, list[float]]:
    """(factor, biases): the logits bias + factor x evidence that fit the (domain, m0, m1, ...) rows best.

    Multinomial logistic regression by Newton steps, each one aggregation.
    Without held-back rows the biases are ``priors`` and the factor one.
    """
    import numpy as np

    k = range(len(domains))
    start = np.array([1.0, *priors])
    ridge = RIDGE * np.eye(len(start))
    pairs = [(i, j) for i in k for j in k if i <= j]

    def state(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Loss, gradient, Hessian and rows at these parameters."""
        z = [F.lit(float(at[0])) * F.col(f"m{i}") + F.lit(float(at[i + 1])) for i in k]
        rows = held.select("*", *[p.alias(f"p{i}") for i, p in enumerate(_softmax(z))])
        m, p = [F.col(f"m{i}") for i in k], [F.col(f"p{i}") for i in k]
        r = [p[i] - (F.col("domain") == d).cast("double") for i, d in enumerate(domains)]
        mean = sum((a * b for a, b in zip(p, m)), F.lit(0.0))
        own = sum((F.when(F.col("domain") == d, p[i]).otherwise(0.0) for i, d in enumerate(domains)), F.lit(0.0))
        got = rows.agg(F.sum(-F.log(F.greatest(own, F.lit(1e-300)))), F.count(F.lit(1)),
                       F.sum(sum((a * b for a, b in zip(r, m)), F.lit(0.0))), *[F.sum(x) for x in r],
                       F.sum(sum((a * b * b for a, b in zip(p, m)), F.lit(0.0)) - mean * mean),
                       *[F.sum(p[i] * (m[i] - mean)) for i in k],
                       *[F.sum(p[i] * (F.lit(float(i == j)) - p[j])) for i, j in pairs]).first()
        got = [float(x or 0.0) for x in got]
        n = len(domains)
        g, h = np.array(got[2:3 + n]), np.zeros((n + 1, n + 1))
        h[0, 0] = got[3 + n]
        h[0, 1:] = h[1:, 0] = got[4 + n:4 + 2 * n]
        for (i, j), x in zip(pairs, got[4 + 2 * n:]):
            h[i + 1, j + 1] = h[j + 1, i + 1] = x
        off = at - start
        return got[0] + off @ ridge @ off / 2, g + ridge @ off, h + ridge, got[1]

    at = start
    loss, g, h, n = state(at)
    for _ in range(steps if n else 0):
        move = np.linalg.solve(h, g)
        if np.abs(g).max() <= 1e-9 * n:
            break
        for _ in range(20):
            there = state(at - move)
            if there[0] <= loss:
                break
            move = move / 2
        else:
            break
        at, (loss, g, h, _) = at - move, there
    return float(at[0]), at[1:].tolist()


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], kept: list[str], factor: float = 1.0) -> DataFrame:
    """One row per row of ``docs`` (``kept``, text): ``kept``, tokens and p0, p1, ...; no evidence means the prior.

    ``priors`` are the logits without evidence (or the calibrated biases), ``factor`` scales the mean evidence.
    """
    k = range(len(priors))
    rows = docs.select(*kept, _features(F.col("text")).alias("f")).select(*kept, F.col("f.tokens").alias("tokens"), F.col("f.of").alias("of"))
    scored = mean_evidence(rows, weights, [*kept, "tokens"], len(priors))
    z = [F.lit(float(priors[i])) + F.lit(float(factor)) * F.col(f"m{i}") for i in k]
    return scored.select(*kept, "tokens", *[p.alias(f"p{i}") for i, p in enumerate(_softmax(z))])


def rate_of(multipliers: list[float]) -> Column:
    """The projected rate: one less posteriors . multipliers, never below zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(multipliers)),
                                                   F.lit(0.0)))


def fit_rates(scored: DataFrame, shares: list[float], anchor: int | None = None, steps: int = STEPS,
              tolerance: float = TOLERANCE, pull: float = PULL) -> tuple[list[float], list[float], list[float]]:
    """(multipliers, totals reached, target totals) for (tokens, p0, p1, ...) rows.

    Targets are ``shares`` of a total: all tokens, or as many as leave the
    ``anchor`` domain's total unchanged.  A step that does not bring the
    errors down is halved.  Domains without tokens and targets that no rates
    can meet leave the least-squares answer.
    """
    import numpy as np

    k = range(len(shares))
    rate = F.col("rate")

    def totals(multipliers) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals, and the Gram matrix over documents with a positive rate."""
        rows = scored.select("*", rate_of(list(multipliers)).alias("rate"))
        pair = [(i, j) for i in k for j in k if i <= j]
        got = rows.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}") * rate) for i in k],
                       *[F.sum(F.when(rate > 0, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}"))) for i, j in pair]).first()
        got = [float(x or 0.0) for x in got]
        gram = np.zeros((len(shares), len(shares)))
        for (i, j), x in zip(pair, got[len(shares):]):
            gram[i, j] = gram[j, i] = x
        return np.array(got[:len(shares)]), gram

    at = np.zeros(len(shares))
    now, gram = totals(at)
    weight, total = sum(shares), float(now.sum())
    if total <= 0:
        return [0.0] * len(shares), now.tolist(), [0.0] * len(shares)
    wanted = total
    if anchor is not None and shares[anchor] > 0 and now[anchor] > 0:
        wanted = now[anchor] / (shares[anchor] / weight)
    target = np.array([wanted * s / weight for s in shares])
    error = now - target - pull * total * at
    for _ in range(steps):
        if np.abs(error).max() <= tolerance * wanted:
            break
        move = np.linalg.solve(gram + pull * total * np.eye(len(shares)), error)
        for _ in range(12):
            there, gram_there = totals(at + move)
            left = there - target - pull * total * (at + move)
            if np.abs(left).sum() < np.abs(error).sum():
                at, now, gram, error = at + move, there, gram_there, left
                break
            move = move / 2
        else:
            break
    return at.tolist(), now.tolist(), target.tolist()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], anchor: str | None = None,
                 doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(``keep``, tokens, p_<domain>..., rate), one row per row of ``docs``.

    ``labels`` is (id, domain) with at most one row per id; rows with other
    domains than the targets', or a null id, teach nothing.  With no labelled
    document all domains are equally likely.  Null texts and texts without a
    token have the prior as posterior and a rate like any other; long texts
    are read whole; repeated rows get equal rates.  The output has the names of
    ``keep`` and its own, which must differ; an empty table gives none.
    """
    if {c.lower() for c in (keep or [doc_id])} & {"tokens", "rate", *(f"p_{d}".lower() for d in targets)}:
        raise ValueError("a kept column has the name of an added one")
    domains = sorted(targets)
    keep = [doc_id] if keep is None else keep
    known = labels.filter(F.col("domain").isin(domains) & F.col("id").isNotNull())
    weights, priors, held = evidence(docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")),
                                     known, domains)
    held = materialize(mean_evidence(held, weights, ["domain"], len(domains)), "held_back")
    factor, biases = calibrate(held, priors, domains)
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    inner = [f"keep{i}" for i in range(len(keep))]
    scored = materialize(posteriors(docs.select(*kept, F.col(f"`{text}`").alias("text")), weights, biases, inner, factor), "posteriors")
    multipliers, _, _ = fit_rates(scored, [targets[d] for d in domains], domains.index(anchor) if anchor else None)
    return scored.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "tokens",
                         *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate_of(multipliers).alias("rate"))


def copies(rate: Column, spot: Column) -> Column:
    """Whole copies whose expectation is the rate: its floor, and one more where a hash in [0, 1) is below the rest."""
    return (F.floor(rate) + (spot < rate - F.floor(rate)).cast("int")).cast("int")


def _spot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def quality_labels(labels: DataFrame) -> DataFrame:
    """(id, domain) of a labels table: several rows of one id count as toxic if any is, else as of quality if any is."""
    one = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("id", label_domain(F.col("q"), F.col("t")).alias("domain")).filter("domain is not null")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, anchor: str | None = ANCHOR,
        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row repeated as often as its rate says (none at all for some).

    All columns are kept, whatever their names.  Rows of equal id and text are
    repeated alike; null, empty and long texts as in ``mixing_rates``.
    """
    k1, k2, n = fresh(docs, "k1", "k2", "copies")
    h1, h2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.withColumns({k1: h1, k2: h2})
    rates = mixing_rates(keyed, quality_labels(labels), targets, anchor, doc_id, text, [k1, k2])
    times = materialize(rates.groupBy(k1, k2).agg(F.max("rate").alias("rate"))
                        .select(k1, k2, copies(F.col("rate"), _spot(F.col(k2))).alias(n))
                        .filter(F.col(n) != 1), "mixing_copies")
    out = join_by_size(keyed, times, [k1, k2], "left").withColumn(n, F.coalesce(n, F.lit(1))).filter(F.col(n) > 0)
    out = out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def document_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, p_good, p_poor, p_toxic, rate, copies for every document, see ``mixing_rates``."""
    docs = docs.select("doc_id", "text")
    h1, h2 = row_key("doc_id", "text")
    rates = mixing_rates(docs.withColumns({"k1": h1, "k2": h2}), quality_labels(labels), TARGETS, ANCHOR,
                         keep=["doc_id", "k2"])
    return rates.withColumn("copies", copies(F.col("rate"), _spot(F.col("k2")))).drop("k2")
