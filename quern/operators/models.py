"""Multinomial naive Bayes, linear SVM and the majority baseline over long-form features, and their selection."""

from __future__ import annotations

import itertools
import json
import math
import mmap
import secrets
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import preprocess
from quern.labels import LABELS
from quern.operators.evaluate import macro_metrics
from quern.operators.features import FeatureModel, Vectorizer, fit
from quern.sources.tables import dataset_hash, metadata_hash, read_json, write_json
from quern.workspace import Workspace, maybe_broadcast


def _best(scores: DataFrame) -> DataFrame:
    """(id, predicted_label, scores) from (id, label, score); ties go to the alphabetically first label."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "label"))
    return scores.groupBy("id").agg(best.alias("b"), F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores")).select("id", F.col("b.label").alias("predicted_label"), "scores")


def _per_label(rows: DataFrame, table: list[dict]) -> DataFrame:
    """The rows once for each label, with the label's values; the table has one entry a label."""
    entries = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in table]
    return rows.withColumn("_l", F.explode(F.array(*entries))).select(*rows.columns, "_l.*")


@dataclass
class NaiveBayes:
    """priors: (label, n, log_prior); theta: (label, term, log_theta) for the terms that occur with the label; rest: (label, log_rest) for all others."""

    priors: DataFrame
    theta: DataFrame
    rest: DataFrame
    alpha: float

    def predict(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """(id, predicted_label, scores): scores are the joint log likelihoods; a text without features gets the prior.

        A term's weight is log_rest everywhere plus a correction where it occurs with the label,
        so the model table holds only pairs that occur.
        """
        sums = features.groupBy("id").agg(F.sum("value").alias("total"))
        extra = self.theta.join(self.rest, "label").select("label", "term", (F.col("log_theta") - F.col("log_rest")).alias("more"))
        fixes = features.join(maybe_broadcast(extra, 1_000_000), "term").groupBy("id", "label").agg(F.sum(F.col("value") * F.col("more")).alias("more"))
        known = self.priors.join(self.rest, "label").select("label", "log_prior", "log_rest").collect()  # one row a label
        base = _per_label(rows.select("id").distinct().join(sums, "id", "left"), [r.asDict() for r in known])
        scores = base.join(fixes, ["id", "label"], "left")
        score = F.col("log_prior") + F.coalesce("total", F.lit(0.0)) * F.col("log_rest") + F.coalesce("more", F.lit(0.0))
        return _best(scores.select("id", "label", score.alias("score")))


def fit_naive_bayes(labelled: DataFrame, features: DataFrame, vocabulary: DataFrame, alpha: float = 1.0) -> NaiveBayes:
    """labelled: (id, label); features: (id, term, value) of the same rows. Priors are not smoothed."""
    work = Workspace(labelled.sparkSession, "bayes")
    n = work.save(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    priors = n.select("label", "n", F.ln(F.col("n") / F.lit(total)).alias("log_prior"))
    per_term = features.join(labelled.select("id", "label"), "id").groupBy("label", "term").agg(F.sum("value").alias("s"))
    per_term = work.save(per_term)
    size = vocabulary.select("term").distinct().count()
    sums = priors.select("label").join(per_term.groupBy("label").agg(F.sum("s").alias("sum")), "label", "left")
    norm = work.save(sums.select("label", (F.coalesce("sum", F.lit(0.0)) + F.lit(alpha * size)).alias("norm")))
    theta = per_term.join(F.broadcast(norm), "label").select("label", "term", F.ln((F.col("s") + alpha) / F.col("norm")).alias("log_theta"))  # one row per label
    return NaiveBayes(priors, theta, norm.select("label", F.ln(F.lit(alpha) / F.col("norm")).alias("log_rest")), alpha)


@dataclass
class LinearSvm:
    """weights: (label, term, weight), the term '' is the bias."""

    weights: DataFrame
    labels: tuple[str, ...]
    iterations: int
    gradient_norm: float

    def predict(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """(id, predicted_label, scores): scores are the one-against-rest margins. features: (id, term, value)."""
        bias = self.weights.where("term = ''").select("label", F.col("weight").alias("bias")).collect()  # one row a label
        base = _per_label(rows.select("id").distinct(), [r.asDict() for r in bias])
        sums = features.join(maybe_broadcast(self.weights.where("term <> ''"), 1_000_000), "term").groupBy("id", "label").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
        scores = base.join(sums, ["id", "label"], "left").select("id", "label", (F.col("bias") + F.coalesce("s", F.lit(0.0))).alias("score"))
        return _best(scores)


    def predict_packed(self, packed: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """The rows of FeatureModel.pack with predicted_label and scores instead of the features."""
        terms = vocabulary.select("term").orderBy("term").toArrow()["term"].combine_chunks()
        own = self.weights.select("label", "term", "weight").toArrow()  # at most MOST_TERMS a label
        w = np.zeros((len(self.labels), len(terms) + 1))
        w[pc.index_in(own["label"], pa.array(self.labels)).to_numpy(), pc.index_in(own["term"], terms).fill_null(len(terms)).to_numpy()] = own["weight"].to_numpy()
        sent, keep = packed.sparkSession.sparkContext.broadcast(w), [c for c in packed.columns if c not in ("j", "v")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                j, x = np.asarray(b.column("j").flatten()), np.asarray(b.column("v").flatten())
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column("j").offsets)))
                m = np.stack([np.bincount(row, weights=u[j] * x, minlength=b.num_rows) + u[-1] for u in sent.value], axis=1)
                cuts = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(cuts, pa.array(m.ravel()))], [*keep, "m"])

        types = [f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keep).schema]
        scores = packed.select(*keep, "j", "v").mapInArrow(run, ", ".join([*types, "m array<double>"]))
        ranked = F.array(*[F.struct((-F.col("m")[n]).alias("s"), F.lit(x).alias("label")) for n, x in enumerate(self.labels)])
        return scores.select(*keep, F.array_min(ranked)["label"].alias("predicted_label"), F.map_from_arrays(F.array(*map(F.lit, self.labels)), "m").alias("scores"))


class NotConverged(ValueError):
    """The solver reached its last iteration before the gradient was small enough."""


# The solver keeps one weight per term and label on the driver.
MOST_TERMS = 2_000_000


def fit_linear_svm(
    labelled: DataFrame, features: DataFrame, vocabulary: DataFrame, c: float = 1.0, class_weight: str | None = None, tol: float = 1e-4, max_iter: int = 10_000, labels: Sequence[str] = LABELS
) -> LinearSvm:
    """One-against-rest L2-regularized squared-hinge SVMs, the bias regularized as a constant feature.

    features: (id, term, value), or the labelled rows packed with their labels (FeatureModel.pack).
    The rows are cut into blocks of numpy arrays. Losses, gradients and products with the Hessian
    are summed over the blocks by tasks that hold their share for the whole fit and run at the same
    time (a barrier stage); where a session can't promise that, by one Spark job a sum. All labels
    are stepped together. Fails with NotConverged after max_iter Newton steps.
    """
    spark = labelled.sparkSession
    work = Workspace(spark, "svm")
    terms = [r[0] for r in vocabulary.select("term").distinct().orderBy("term").limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: set max_features")
    ordinal = F.create_map(*[F.lit(v) for i, x in enumerate(labels) for v in (x, i)])
    if "j" in features.columns:
        rows = features
    else:
        index = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "j": pa.array(range(len(terms)), pa.int32())}))
        packed = features.join(maybe_broadcast(index, 1_000_000), "term").groupBy("id").agg(F.collect_list(F.struct("j", "value")).alias("x"))
        rows = labelled.select("id", "label").join(packed, "id", "left").select("label", F.coalesce("x.j", F.array().cast("array<int>")).alias("j"), F.coalesce("x.value", F.array().cast("array<double>")).alias("v"))
    rows = rows.select(F.try_element_at(ordinal, F.col("label")).alias("y"), "j", "v").where("y IS NOT NULL")
    k, v = len(labels), len(terms) + 1
    positive, negative = np.full(k, float(c)), np.full(k, float(c))
    if class_weight == "balanced":  # a class weighs as much as all others, as n / (2 * its rows)
        counts = {r["label"]: r["count"] for r in labelled.where(F.col("label").isin(*labels)).groupBy("label").count().collect()}
        n = sum(counts.values())
        for i, x in enumerate(labels):
            positive[i] *= n / (2 * counts[x]) if counts.get(x) else 1.0
            negative[i] *= n / (2 * (n - counts.get(x, 0))) if n > counts.get(x, 0) else 1.0

    def loss(w: np.ndarray, total: np.ndarray, block: _Block, q: int, sign: np.ndarray, cost: np.ndarray) -> None:
        slack = np.maximum(0.0, 1 - sign * block.margins(w[q]))
        total[0] += (cost * slack * slack).sum()
        block.add_to(total[1 : v + 1], -2 * cost * slack * sign, block.x)
        block.add_to(total[v + 1 :], 2 * cost * (slack > 0), block.x * block.x)

    def curved(wp: np.ndarray, total: np.ndarray, block: _Block, q: int, sign: np.ndarray, cost: np.ndarray) -> None:
        inside = sign * block.margins(wp[0, q]) < 1
        block.add_to(total, 2 * cost * inside * block.margins(wp[1, q]), block.x)

    def share(name: str, sent: np.ndarray, blocks: Iterator[list]) -> np.ndarray:
        add, size = {"loss": (loss, 2 * v + 1), "curved": (curved, v)}[name]
        total = np.zeros((k, size))
        for one in blocks:
            block = _Block(*one, v)
            for q in range(k):
                add(sent, total[q], block, q, np.where(block.y == q, 1.0, -1.0), np.where(block.y == q, positive[q], negative[q]))
        return total

    def minimum(summed) -> tuple[np.ndarray, int, float]:
        def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = summed("loss", w)
            return s[:, 0] + 0.5 * (w * w).sum(1), s[:, 1 : v + 1] + w, s[:, v + 1 :] + 1

        return _newton(evaluate, lambda w, p: summed("curved", np.stack([w, p])) + p, np.zeros((k, v)), tol, max_iter)

    slots = _slots(spark)
    if slots:
        w, its, norm = _solve_together(_blocks(rows, v), slots, share, minimum)
        w = w.reshape(k, v)
    else:
        blocks = work.save(_blocks(rows, v), "none")
        w, its, norm = minimum(_summed_by_jobs(blocks, share))
        work.drop(blocks)
    flat = pa.table({"label": pa.array(np.repeat(labels, v)), "term": pa.array([*terms, ""] * k, pa.string()), "weight": pa.array(w.ravel())})
    out = LinearSvm(work.save(spark.createDataFrame(flat).where("weight <> 0 OR term = ''")), tuple(labels), its, norm)
    if norm > tol:
        raise NotConverged(f"gradient {norm:.3g} after {its} iterations")
    return out


# Rows of a block: its arrays stay in the processor's cache.
BLOCK_ROWS = 500
# Sums of more tasks than this are added in tasks before they come to the driver.
MOST_SUMS = 32


def _blocks(rows: DataFrame, v: int) -> DataFrame:
    """(y, sizes, j, x): up to BLOCK_ROWS rows of (y, j, v) as the bytes of four arrays."""
    small = np.uint16 if v <= 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, cuts = np.asarray(b.column(0)).astype(np.int16), np.asarray(b.column(1).offsets)
            j, x = np.asarray(b.column(1).flatten()).astype(small), np.asarray(b.column(2).flatten())
            sizes, cuts = np.diff(cuts).astype(np.int32), cuts - cuts[0]
            at = [(a, min(a + BLOCK_ROWS, len(y))) for a in range(0, len(y), BLOCK_ROWS)]
            made = [[y[a:e].tobytes(), sizes[a:e].tobytes(), j[cuts[a] : cuts[e]].tobytes(), x[cuts[a] : cuts[e]].tobytes()] for a, e in at]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], ["y", "sizes", "j", "x"])

    return rows.mapInArrow(run, "y binary, sizes binary, j binary, x binary")


class _Block:
    """Rows of a sparse matrix with a last column of ones."""

    def __init__(self, y: pa.Buffer, sizes: pa.Buffer, j: pa.Buffer, x: pa.Buffer, v: int):
        self.y, self.sizes, self.x = np.frombuffer(y, np.int16), np.frombuffer(sizes, np.int32), np.frombuffer(x)
        self.j = np.frombuffer(j, np.uint16 if v <= 1 << 16 else np.int32).astype(np.int64)
        self.filled = self.sizes > 0
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.filled]

    def margins(self, w: np.ndarray) -> np.ndarray:
        m = np.full(len(self.y), w[-1])
        if len(self.starts):
            t = np.take(w, self.j)
            t *= self.x
            m[self.filled] += np.add.reduceat(t, self.starts)
        return m

    def add_to(self, total: np.ndarray, d: np.ndarray, x: np.ndarray) -> None:
        """Adds to the total, for each column, the sum of d times the column; ``x`` are its entries."""
        t = np.repeat(d, self.sizes)
        t *= x
        total[:-1] += np.bincount(self.j, weights=t, minlength=len(total) - 1)
        total[-1] += d.sum()


def _slots(spark) -> int:
    """How many tasks the session can run at the same time; 0 if that may change."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _solve_together(blocks: DataFrame, slots: int, share, minimum) -> tuple[np.ndarray, int, float]:
    """The weights, steps and norm of minimum(summed), where summed adds the shares of all tasks.

    Each task keeps its blocks in a mapped file. The first one runs the solver, sends the others
    what to sum and adds their sums; a task that fails ends the others and the stage is tried again.
    """
    key = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        with tempfile.TemporaryFile() as file:
            sizes = []
            for b in batches:
                for one in zip(*(b.column(c) for c in ("x", "sizes", "j", "y"))):
                    parts = [x.as_buffer() for x in one]
                    sizes.append([len(x) for x in parts])
                    file.write(b"".join(parts) + bytes(-sum(sizes[-1]) % 8))
            file.flush()
            mapped = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if sizes else b"")

            def own() -> Iterator[list]:
                at = 0
                for n in sizes:
                    cuts = at + np.cumsum([0, *n])
                    x, rows, j, y = (mapped[a:e] for a, e in itertools.pairwise(cuts.tolist()))
                    yield [y, rows, j, x]
                    at = int(cuts[-1]) + -sum(n) % 8

            if context.partitionId():
                port = context.allGather("")[0]
                host = context.getTaskInfos()[0].address.rpartition(":")[0].strip("[]")
                with Client((host, int(port)), authkey=key) as first:
                    while (asked := first.recv()) is not None:
                        first.send(share(*asked, own()))
                return
            with Listener(("", 0), backlog=slots, authkey=key) as listener:
                context.allGather(str(listener.address[1]))
                others = [listener.accept() for _ in range(slots - 1)]

            def summed(*asked) -> np.ndarray:
                for c in others:
                    c.send(asked)
                return sum((c.recv() for c in others), share(*asked, own()))

            w, its, norm = minimum(summed)
            for c in others:
                c.send(None)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([its], pa.int32()), pa.array([norm])], ["w", "its", "norm"])

    # empty partitions are tasks too, so the number of tasks is that of the slots
    out = blocks.repartition(slots).mapInArrow(run, "w binary, its int, norm double", barrier=True).toArrow()
    return np.frombuffer(out["w"][0].as_buffer()), out["its"][0].as_py(), out["norm"][0].as_py()


def _summed_by_jobs(blocks: DataFrame, share):
    """summed for a minimum that the driver finds: one job a sum."""
    tasks = blocks.select(F.spark_partition_id()).distinct().count()

    def summed(name: str, sent: np.ndarray) -> np.ndarray:
        values = blocks.sparkSession.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = share(name, values.value, ([x.as_buffer() for x in one] for b in batches for one in zip(*b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

        out = _sum(blocks.mapInArrow(run, "s binary"), tasks, share(name, sent, iter(())).ravel())
        values.destroy()
        return out.reshape(sent.shape[-2], -1)

    return summed


def _sum(parts: DataFrame, tasks: int, zero: np.ndarray) -> np.ndarray:
    """The sum of the vectors in column s, one a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column(0):
                one = np.frombuffer(s.as_buffer())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    while tasks > MOST_SUMS:
        tasks = math.isqrt(tasks)
        parts = parts.repartition(tasks).mapInArrow(add, "s binary")
    return sum((np.frombuffer(s.as_buffer()) for s in parts.toArrow()["s"]), zero)


def _newton(evaluate, product, w: np.ndarray, tol: float, max_iter: int, most_products: int = 250) -> tuple[np.ndarray, int, float]:
    """Minimises by Newton steps, one row of w a problem of its own; ends when the gradient's norm is ``tol`` times the first one (then given as such).

    The steps solve with the generalized Hessian by conjugate gradients scaled by its diagonal, as
    closely as the gradient is small, and are halved for the problems that they don't improve.
    """
    value, grad, diagonal = evaluate(w)
    first = float(np.linalg.norm(grad)) or 1.0
    for it in range(max_iter):
        norm = float(np.linalg.norm(grad))
        if norm <= tol * first:
            return w, it, norm / first
        enough = max(min(0.1, math.sqrt(norm / first)) * norm, 0.5 * tol * first)
        d, rest = np.zeros_like(w), -grad
        z = rest / diagonal
        p, old = z, (rest * z).sum(1)
        for _ in range(most_products):
            hp = product(w, p)
            a = (old / np.maximum((p * hp).sum(1), 1e-300))[:, None]
            d, rest = d + a * p, rest - a * hp
            if np.linalg.norm(rest) <= enough:
                break
            z = rest / diagonal
            new = (rest * z).sum(1)
            p, old = z + (new / np.maximum(old, 1e-300))[:, None] * p, new
        step, slope = np.ones(len(w)), (grad * d).sum(1)
        while True:
            fresh, fresh_grad, fresh_diagonal = evaluate(w + step[:, None] * d)
            worse = fresh > value + 1e-4 * step * slope + 1e-12 * np.abs(value)
            if not worse.any() or step.min() < 1e-10:
                break
            step[worse] /= 2
        w, value, grad, diagonal = w + step[:, None] * d, fresh, fresh_grad, fresh_diagonal
    return w, max_iter, float(np.linalg.norm(grad)) / first


def fit_with_retry(labelled, features, vocabulary, retry_max_iter: int = 100_000, max_iter: int = 10_000, **options) -> LinearSvm:
    """fit_linear_svm, once more with retry_max_iter if it did not converge."""
    try:
        return fit_linear_svm(labelled, features, vocabulary, max_iter=max_iter, **options)
    except NotConverged:
        return fit_linear_svm(labelled, features, vocabulary, max_iter=retry_max_iter, **options)


def majority_class(labelled: DataFrame) -> DataFrame:
    """One row (label): the most frequent label, the alphabetically first of equal ones."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1).select("label")


def predict_majority(train: DataFrame, rows: DataFrame) -> DataFrame:
    label = majority_class(train).first()
    if label is None:
        raise ValueError("the training set is empty")
    return rows.select("id", F.lit(label[0]).alias("predicted_label"))


def predictions(rows: DataFrame, predicted: DataFrame, model_name: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """The prediction table: id, post_id if there is one, text, true_label ('' if unlabelled), predicted_label, model_name, probability_<label> if given."""
    keep = ["id", *(["post_id"] if "post_id" in rows.columns else []), "text"]
    true = F.col("label") if "label" in rows.columns else F.lit("")
    out = rows.select(*keep, true.alias("true_label")).join(predicted, "id")
    probabilities = [F.try_element_at("probabilities", F.lit(x)).alias(f"probability_{x}") for x in labels] if "probabilities" in predicted.columns else []
    return out.select(*keep, "true_label", "predicted_label", F.lit(model_name).alias("model_name"), *probabilities)


def softmax(scores: DataFrame) -> DataFrame:
    """Adds ``probabilities``, the softmax of the scores map (for log likelihoods: the posterior)."""
    top = F.array_max(F.map_values("scores"))
    shifted = F.transform_values("scores", lambda _, s: F.exp(s - top))
    total = F.aggregate(F.map_values("_e"), F.lit(0.0), lambda a, x: a + x)
    return scores.withColumn("_e", shifted).withColumn("probabilities", F.transform_values("_e", lambda _, e: e / total)).drop("_e")


def _cleaned(emoji_mode: str, stop_words: Sequence[str] | None) -> Column:
    return preprocess(F.col("text"), stop_words=list(stop_words) if stop_words else None, emoji_mode=emoji_mode)


@dataclass
class Pipeline:
    """A fitted preprocessing, vocabulary and classifier."""

    name: str
    settings: dict
    features: FeatureModel
    model: NaiveBayes | LinearSvm
    score: float = 0.0

    def predict(self, rows: DataFrame) -> DataFrame:
        clean = rows.withColumn("text", _cleaned(self.settings.get("emoji", "keep"), self.settings.get("stop_words")))
        return self.model.predict(clean, self.features.transform(clean))


@dataclass
class Search:
    best: Pipeline
    log: list[dict] = field(default_factory=list)


def search(
    train: DataFrame, validation: DataFrame, feature: str, algorithm: str, ngrams: Sequence[tuple[int, int]] = ((1, 1), (1, 2)), params: Sequence[float] = (0.5, 1.0), emoji_modes: Sequence[str] = ("keep",), class_weights: Sequence[str | None] = (None,), min_dfs: Sequence[int] = (1,), sublinear: Sequence[bool] = (False,), max_features: int | None = 20_000, about: dict | None = None, stop_words: Sequence[str] | None = None
) -> Search:
    """Tries all settings in order and keeps the first with the largest validation Macro-F1; nothing is refitted on the validation rows.

    The settings are few; each trial is a distributed fit over normalized texts that are written
    once per emoji mode. ``about`` (the hash of the splits, say) becomes part of the settings.
    """
    if algorithm not in ("nb", "svm"):
        raise ValueError("algorithm must be nb or svm")
    work = Workspace(train.sparkSession, "search")
    texts: dict[str, tuple[DataFrame, DataFrame]] = {}
    out, log = None, []
    grid = itertools.product(ngrams, params, emoji_modes, class_weights, min_dfs, sublinear)
    for n, (ngram, param, mode, weight, min_df, sub) in enumerate(grid):
        if mode not in texts:
            texts[mode] = tuple(work.save(d.select("id", "label", _cleaned(mode, stop_words).alias("text"))) for d in (train, validation))
        tr, va = texts[mode]
        fm = fit(tr, Vectorizer(feature, ngram, min_df=min_df, max_features=max_features, sublinear_tf=sub))
        x = work.save(fm.transform(tr))
        model = fit_naive_bayes(tr, x, fm.vocabulary, param) if algorithm == "nb" else fit_with_retry(tr, x, fm.vocabulary, c=param, class_weight=weight)
        pred = model.predict(va, fm.transform(va)).join(va.select("id", F.col("label").alias("true_label")), "id")
        score = macro_metrics(pred).first()["macro_f1"]
        settings = {"candidate": n, "feature": feature, "algorithm": algorithm, "ngram": list(ngram), "param": param, "emoji": mode, "class_weight": weight, "min_df": min_df, "sublinear": sub, "stop_words": list(stop_words or [])} | (about or {})
        log.append(settings | {"validation_macro_f1": score})
        if out is None or score > out.score:
            out = Pipeline(f"{feature}+{algorithm}", settings, fm, model, score)
    return Search(out, log)


def _model_tables(p: Pipeline) -> dict[str, DataFrame]:
    own = {n: getattr(p.model, n) for n in ("priors", "theta", "rest")} if isinstance(p.model, NaiveBayes) else {"weights": p.model.weights}
    return {"vocabulary": p.features.vocabulary} | own


def save_pipeline(p: Pipeline, path: str) -> dict:
    """Writes the tables and settings of a pipeline and reads them back: other predictions or hashes are an error, as is an existing path; the metadata."""
    spark = p.features.vocabulary.sparkSession
    for name, df in _model_tables(p).items():
        df.write.parquet(f"{path}/{name}")
    hashes = {name: dataset_hash(spark.read.parquet(f"{path}/{name}")) for name in _model_tables(p)}
    about = {"name": p.name, "settings": p.settings, "score": p.score, "n_docs": p.features.n_docs, "vectorizer": p.features.vectorizer.__dict__, "labels": list(LABELS), "tables_sha256": hashes}
    spark.createDataFrame([(json.dumps(about, ensure_ascii=False, sort_keys=True),)], "metadata string").coalesce(1).write.text(f"{path}/metadata")
    return about


def load_pipeline(spark, path: str) -> Pipeline:
    """Reads a saved pipeline; tables that were changed, or other labels than ours, are an error."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if tuple(about["labels"]) != LABELS:
        raise ValueError("the model was trained for other labels")
    saved = {name: spark.read.parquet(f"{path}/{name}") for name in about["tables_sha256"]}
    if changed := [name for name, df in saved.items() if dataset_hash(df) != about["tables_sha256"][name]]:
        raise ValueError(f"tables of the model were changed: {changed}")
    v = Vectorizer(**{k: tuple(x) if isinstance(x, list) else x for k, x in about["vectorizer"].items()})
    fm = FeatureModel(v, saved["vocabulary"], about["n_docs"])
    if about["settings"]["algorithm"] == "nb":
        model = NaiveBayes(*[saved[n] for n in ("priors", "theta", "rest")], about["settings"]["param"])
    else:
        model = LinearSvm(saved["weights"], LABELS, 0, 0.0)
    return Pipeline(about["name"], about["settings"], fm, model, about["score"])


def selection_lock(spark, path: str, chosen: dict[str, dict], manifest_hash: str) -> dict:
    """Writes which saved models (name -> metadata of save_pipeline) were selected on which splits, before any test row is predicted; an existing lock is an error."""
    lock = {"split_manifest_sha256": manifest_hash, "test_predictions_computed": False, "models": {n: {"tables_sha256": m["tables_sha256"], "validation_macro_f1": m["score"]} for n, m in sorted(chosen.items())}}
    write_json(spark, path, lock | {"lock_sha256": metadata_hash(lock)})
    return lock


def check_lock(spark, path: str, name: str, about: dict, manifest_hash: str) -> None:
    """An error if the lock was changed, or if a model is not the one that was selected on these splits."""
    lock = read_json(spark, path)
    if metadata_hash({k: v for k, v in lock.items() if k != "lock_sha256"}) != lock["lock_sha256"]:
        raise ValueError("the lock was changed")
    if lock["split_manifest_sha256"] != manifest_hash or lock["models"].get(name, {}).get("tables_sha256") != about["tables_sha256"]:
        raise ValueError(f"{name} is not the model that was selected")


def truncation(lengths: DataFrame, most: int, length: str = "n_tokens") -> DataFrame:
    """One row: rows longer than ``most``, the longest, and the share of longer ones (0 for no rows)."""
    return lengths.agg(F.count_if(F.col(length) > most).alias("n_truncated"), F.coalesce(F.max(length), F.lit(0)).alias("longest"), F.coalesce(F.avg((F.col(length) > most).cast("double")), F.lit(0.0)).alias("truncated_share"))
