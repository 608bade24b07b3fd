"""Problem 4: consensus labels, agreement and reviewer reliability from disagreeing votes.

Confidence-aware truth discovery (CATD): a reviewer's weight is the lower chi-squared quantile
for the number of their votes over the sum of their label distances, which is the inverse of an
upper bound of their error variance; so reviewers with few votes get no weight they haven't
earned. Consensus labels minimise the weighted distance. Both steps alternate until no reviewer's
distances change. A vote's distance is taken from the consensus of the item's other reviewers:
measured from a consensus that holds the vote itself, a reviewer who once has the largest weight
decides every item, seems free of errors and keeps all the weight.

Items of which all votes are equal give no distance in any round, so only the votes of contested
items are read again; a reviewer's number of votes, and with it the quantile, never changes.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.words import strip
from quern.labels import LABELS
from quern.workspace import Workspace, maybe_broadcast

ALPHA = 0.05
# Distances are sums of 0 and 1; this is added so that a reviewer without errors keeps a finite weight.
SMOOTH = 0.5
# Rounds without an end (neither a fixed point nor a cycle) are an error.
MOST_ROUNDS = 500


def chi2_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The lower p-quantiles (p well below 1/2) of the chi-squared distributions with ``df`` degrees of freedom.

    One formula for all df: the gamma density over the logarithm of x / df falls off to the left
    of any point below its mode at least as fast as there, so Gauss-Legendre nodes over 45 such
    lengths give the distribution function, and bisection inverts it.
    """
    a = np.atleast_1d(np.asarray(df, dtype=np.float64))[:, None] / 2
    nodes, weights = np.polynomial.legendre.leggauss(160)
    nodes, weights = (nodes + 1) / 2, weights / 2
    # the density's constant a**a * exp(-a) / gamma(a), by Stirling's series from a + 10 down
    up = a + 10
    log_gamma = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    const = a * np.log(a) - a - (log_gamma - np.log(a + np.arange(10)[None, :]).sum(axis=1, keepdims=True))

    def below(s: np.ndarray) -> np.ndarray:
        length = 45 / (a * -np.expm1(s))
        at = s - length * nodes
        return (np.exp(const + a * (at - np.expm1(at))) * weights).sum(axis=1, keepdims=True) * length

    lo, hi = np.full_like(a, -200.0), np.full_like(a, -1e-12)
    for _ in range(70):
        mid = (lo + hi) / 2
        less = below(mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (2 * a * np.exp((lo + hi) / 2))[:, 0]


def counting_votes(annotations: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, reviewer, label): the latest counting vote of each reviewer for each id.

    A row counts if its label, in lower case and without white space at the ends, is one of
    ``labels``, its status is human_confirmed and id and reviewer are not missing. Rows without a
    time are the oldest; of rows with one time the last label in alphabetical order counts.
    """
    label, reviewer = F.lower(strip(F.col("label"))), F.lower(strip(F.col("reviewer")))
    rows = annotations.select("id", reviewer.alias("reviewer"), label.alias("label"), "submitted_at", "annotation_status")
    rows = rows.where(F.col("label").isin(*labels) & (F.col("annotation_status") == "human_confirmed") & (F.col("reviewer") != "") & (F.col("id") != ""))
    latest = rows.groupBy("id", "reviewer").agg(F.max(F.struct(F.coalesce(F.col("submitted_at").cast("double"), F.lit(-1e300)).alias("at"), "label")).alias("last"))
    return latest.select("id", "reviewer", F.col("last.label").alias("label"))


def _tally(votes: DataFrame, weight: Column, labels: Sequence[str]) -> DataFrame:
    """Per id: number of votes, votes of each label, and the label with the largest sum of weights (ties: more votes, then label order)."""
    sums = [F.sum(F.when(F.col("label") == x, weight).otherwise(0.0)).alias(f"w{i}") for i, x in enumerate(labels)]
    counts = [F.count_if(F.col("label") == x).alias(f"c{i}") for i, x in enumerate(labels)]
    t = votes.groupBy("id").agg(F.count(F.lit(1)).alias("n_votes"), *sums, *counts)
    # sums of doubles depend on the order of rows in their last digits, so they are compared rounded
    best = F.array_max(F.array(*[F.struct(F.round(f"w{i}", 6).alias("w"), F.col(f"c{i}").alias("c"), F.lit(-i).alias("o"), F.lit(x).alias("label"), F.col(f"w{i}").alias("sum")) for i, x in enumerate(labels)]))
    total = sum((F.col(f"w{i}") for i in range(1, len(labels))), F.col("w0"))
    top = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(-i).alias("o"), F.lit(x).alias("label")) for i, x in enumerate(labels)]))
    return t.select("id", "n_votes", *[f"w{i}" for i in range(len(labels))], best["label"].alias("consensus"), (best["sum"] / total).alias("support"), top["label"].alias("top_label"), top["c"].alias("top_votes"))


def _distances(judged: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(reviewer, errors): the sums of the votes' distances from the others' consensus; shares of a vote where the others are undecided."""
    others = [F.round(F.col(f"w{i}") - F.when(F.col("label") == x, F.col("weight")).otherwise(0.0), 6) for i, x in enumerate(labels)]
    top = F.greatest(*others)
    ties = sum((F.when(o == top, 1).otherwise(0) for o in others[1:]), F.when(others[0] == top, 1).otherwise(0))
    own = F.coalesce(*[F.when((F.col("label") == x) & (o == top), 1.0) for x, o in zip(labels, others)], F.lit(0.0))
    return judged.select("reviewer", F.when(top > 0, 1 - own / ties).otherwise(0.0).alias("distance")).groupBy("reviewer").agg(F.sum("distance").alias("errors"))


def _with_bounds(reviewers: DataFrame, alpha: float) -> DataFrame:
    """Adds ``bound``, the quantile for n_judged votes (for none: for one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, at = np.unique(np.maximum(np.asarray(b.column(2)), 1), return_inverse=True)
            bound = chi2_quantile(alpha / 2, kinds)[at] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound, pa.float64())], [*b.schema.names, "bound"])

    return reviewers.select("reviewer", "n_votes", "n_judged").mapInArrow(run, "reviewer string, n_votes bigint, n_judged bigint, bound double")


class Consensus:
    """Result of :func:`discover`.

    items: (id, consensus, support, n_votes, top_label, top_votes, agreement); support is the
    weight of the consensus over all weights of the item, agreement the share of pairs of votes
    with one label, NULL for a single vote. reviewers: (reviewer, n_votes, errors, reliability,
    accuracy); reliability is the weight over the largest one, accuracy is NULL if nobody else
    voted on the reviewer's items. votes: (id, reviewer, label). rounds: how many it took;
    converged: whether the last one changed nothing.
    """

    def __init__(self, items: DataFrame, reviewers: DataFrame, votes: DataFrame, rounds: int, converged: bool):
        self.items, self.reviewers, self.votes, self.rounds, self.converged = items, reviewers, votes, rounds, converged


def discover(annotations: DataFrame, labels: Sequence[str] = LABELS, alpha: float = ALPHA) -> Consensus:
    """Consensus of the counting votes; empty tables give empty results.

    The votes stay in rows, so an item or a reviewer may hold any share of them: the per-item and
    per-reviewer sums are combined before the shuffle, and the joins are split by the adaptive
    skew join. Reviewer weights are broadcast only if they are checked to be few. The alternation
    ends when the reviewers' distances repeat those of the last round; if they repeat those of an
    earlier one instead, a warning names the length of the cycle, and ``converged`` is false.
    """
    work = Workspace(annotations.sparkSession, "consensus")
    votes = work.save(counting_votes(annotations, labels))
    counts = work.save(votes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")))
    contested = work.save(votes.join(counts.where("lo < hi").select("id"), "id", "left_semi"))
    per_reviewer = votes.join(counts.select("id", "n"), "id").groupBy("reviewer").agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("n") > 1).alias("n_judged"))
    base = work.save(_with_bounds(per_reviewer, alpha))
    sized = maybe_broadcast(base)  # the same reviewers have weights in every round
    few = sized is not base
    # a reviewer without any judged vote counts like one vote with an error
    weight = F.col("bound") / (F.when(F.col("n_judged") > 0, F.coalesce("errors", F.lit(0.0))).otherwise(1.0) + F.lit(SMOOTH))

    def with_weights(reviewers: DataFrame) -> DataFrame:
        w = reviewers.select("reviewer", "weight")
        return contested.join(F.broadcast(w) if few else w, "reviewer")  # few: counted by maybe_broadcast

    def tallied(weighted: DataFrame) -> DataFrame:
        return _tally(weighted, F.col("weight"), labels)

    reviewers = base.withColumns({"errors": F.lit(0.0), "weight": F.lit(1.0)})
    seen: dict[tuple, int] = {}
    for turn in range(MOST_ROUNDS):
        weighted = with_weights(reviewers)
        judged = weighted.join(tallied(weighted).select("id", *[f"w{i}" for i in range(len(labels))]), "id")
        errors = _distances(judged, labels).withColumn("errors", F.round("errors", 6))
        new = base.join(F.broadcast(errors) if few else errors, "reviewer", "left").withColumn("errors", F.coalesce("errors", F.lit(0.0))).withColumn("weight", weight)
        new, now = work.save_counted(new, digest=F.bit_xor(F.xxhash64("reviewer", "errors")))
        if hasattr(reviewers, "_quern_path"):
            work.drop(reviewers)
        reviewers = new
        key = (now["n"], now["digest"])
        if key in seen:
            break
        seen[key] = turn
    else:
        raise ValueError(f"the consensus did not settle in {MOST_ROUNDS} rounds")
    converged = seen[key] == turn - 1
    if not converged:
        warnings.warn(f"the consensus runs in a cycle of {turn - seen[key]} rounds", stacklevel=2)
    decided = tallied(with_weights(reviewers)).select("id", "consensus", "support", "n_votes", "top_label", "top_votes")
    plain = counts.where("lo = hi").select("id", F.col("lo").alias("consensus"), F.lit(1.0).alias("support"), F.col("n").alias("n_votes"), F.col("lo").alias("top_label"), F.col("n").alias("top_votes"))
    pairs = contested.groupBy("id", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("equal"))
    agreement = F.when(F.col("n_votes") > 1, F.coalesce("equal", F.col("n_votes") * (F.col("n_votes") - 1)) / (F.col("n_votes") * (F.col("n_votes") - 1)))
    items = decided.unionByName(plain).join(pairs, "id", "left").withColumn("agreement", agreement).drop("equal")
    items = work.save(items)
    top = reviewers.agg(F.max("weight")).first()[0] or 1.0
    shown = reviewers.select("reviewer", "n_votes", "errors", (F.col("weight") / F.lit(top)).alias("reliability"), (1 - F.col("errors") / F.nullif("n_judged", F.lit(0))).alias("accuracy"))
    return Consensus(items, shown, votes, turn + 1, converged)


def outvoted(annotations: DataFrame, least: int = 3) -> DataFrame:
    """(id, reviewer): votes against a label that more than half of at least ``least`` reviewers gave.

    The candidates are the votes of items whose weighted vote in :func:`discover` is not of one
    mind (a label other than the consensus holds weight; all weights are positive, so no case is
    lost); the exact count of votes follows.
    """
    found = discover(annotations)
    split = found.items.where(F.col("support") < 1)
    clear = split.where((F.col("n_votes") >= least) & (2 * F.col("top_votes") > F.col("n_votes")))
    return found.votes.join(clear.select("id", "top_label"), "id").where("label <> top_label").select("id", "reviewer")
