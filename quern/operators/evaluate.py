"""Confusion matrices, precision, recall and F1, slices and comparisons of predictions.

Prediction tables have true_label and predicted_label. Everything is one aggregation over them;
what follows works on a 3 x 3 table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import slices
from quern.labels import LABELS


def confusion_matrix(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(true_label, one column per predicted label): counts, with a row for every label."""
    scaffold = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "o int, true_label string")
    counts = df.groupBy("true_label").agg(*[F.count_if(F.col("predicted_label") == x).alias(x) for x in labels])
    return scaffold.join(counts, "true_label", "left").na.fill(0, list(labels)).select("true_label", *labels)


def _counts(labels: Sequence[str]) -> list[Column]:
    t, p = F.col("true_label"), F.col("predicted_label")
    out = [F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("right")]
    for i, x in enumerate(labels):
        out += [F.count_if((t == x) & (p == x)).alias(f"tp{i}"), F.count_if(t == x).alias(f"t{i}"), F.count_if(p == x).alias(f"p{i}")]
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(i: int) -> tuple[Column, Column, Column]:
    p, r = _ratio(F.col(f"tp{i}"), F.col(f"p{i}")), _ratio(F.col(f"tp{i}"), F.col(f"t{i}"))
    return p, r, _ratio(2 * p * r, p + r)


def _macro(k: int, labels: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [_prf(i)[k] for i in range(len(labels))]) / len(labels)


def label_metrics(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, precision, recall, f1, support) of every label; a ratio without cases is 0."""
    one = df.agg(*_counts(labels))
    rows = [F.struct(F.lit(x).alias("label"), *[c.alias(n) for c, n in zip(_prf(i), ("precision", "recall", "f1"))], F.col(f"t{i}").alias("support")) for i, x in enumerate(labels)]
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def macro_metrics(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: n_samples, accuracy, and the unweighted means of precision, recall and F1 over the labels; NULL accuracy for no rows."""
    one = df.agg(*_counts(labels))
    return one.select(F.col("n").alias("n_samples"), F.when(F.col("n") > 0, F.col("right") / F.col("n")).alias("accuracy"), *[_macro(k, labels).alias(f"macro_{n}") for k, n in enumerate(("precision", "recall", "f1"))])


def checked(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The predictions; empty ones or unknown labels are an error."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("true_label").isin(*labels) & F.col("predicted_label").isin(*labels), F.lit(False))).alias("bad")).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError("no predictions" if not seen["n"] else f"{seen['bad']} rows with labels outside {labels}")
    return df


def slice_metrics(df: DataFrame, text: str = "text", labels: Sequence[str] = LABELS) -> DataFrame:
    """(group, support, accuracy, macro_f1, errors) of the overlapping text slices; empty slices are left out."""
    rows = df.select("true_label", "predicted_label", F.explode(slices(F.coalesce(F.col(text), F.lit("")))).alias("group"))
    per = rows.groupBy("group").agg(*_counts(labels))
    return per.select("group", F.col("n").alias("support"), (F.col("right") / F.col("n")).alias("accuracy"), _macro(2, labels).alias("macro_f1"), (F.col("n") - F.col("right")).alias("errors"))


def errors_by(df: DataFrame, group: str = "post_id") -> DataFrame:
    """(group, support, errors)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("true_label") != F.col("predicted_label")).alias("errors"))


def misclassified(df: DataFrame) -> DataFrame:
    return df.where("true_label <> predicted_label")


SIGNATURE = ("split_manifest_sha256", "evaluation_data_sha256", "split", "provenance", "n_samples")


def compare(results: DataFrame) -> DataFrame:
    """The results of several models, best macro_f1 first (then by name); different data or a repeated model_name is an error."""
    seen = results.agg(F.countDistinct(F.struct(*SIGNATURE)).alias("k"), F.count(F.lit(1)).alias("n"), F.countDistinct("model_name").alias("m")).first()
    if seen["k"] != 1 or seen["n"] != seen["m"]:
        raise ValueError("results must be of the same data, one for each model")
    return results.select("model_name", "split", "provenance", "n_samples", "accuracy", "macro_precision", "macro_recall", "macro_f1").orderBy(F.desc("macro_f1"), "model_name")


def evaluation_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All tables of one evaluation by name."""
    df = checked(df)
    out = {"metrics": macro_metrics(df), "per_label": label_metrics(df), "confusion_matrix": confusion_matrix(df), "error_groups": slice_metrics(df), "predictions": df, "errors": misclassified(df)}
    return out | ({"errors_by_post": errors_by(df)} if "post_id" in df.columns else {})


def report(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """label_metrics and a row macro_avg with their means and the number of rows."""
    per = label_metrics(df, labels)
    mean = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return per.unionByName(mean.select(F.lit("macro_avg").alias("label"), "precision", "recall", "f1", "support"))


def evaluate_model(pipeline, rows: DataFrame, manifest: dict, split: str = "test", provenance: str = "real") -> dict[str, DataFrame]:
    """The tables of a fitted pipeline's evaluation on a split of saved splits, with the signature that :func:`compare` needs.

    A pipeline that was not selected on these splits (its settings name another manifest hash) is
    refused.
    """
    from quern.operators.models import predictions

    if pipeline.settings.get("split_manifest_sha256") != manifest["manifest_sha256"]:
        raise ValueError("the model was selected on other splits")
    own = rows.where(F.col("split") == split)
    tables = evaluation_tables(predictions(own, pipeline.predict(own), pipeline.name))
    signed = tables["metrics"].select(
        F.lit(pipeline.name).alias("model_name"), F.lit(manifest["manifest_sha256"]).alias("split_manifest_sha256"), F.lit(manifest["splits"][split]["sha256"]).alias("evaluation_data_sha256"),
        F.lit(split).alias("split"), F.lit(provenance).alias("provenance"), "*",
    )
    return tables | {"metrics": signed, "report": report(tables["predictions"])}


def confident(df: DataFrame) -> DataFrame:
    """The predictions with ``confidence``, the largest of their probabilities."""
    columns = [c for c in df.columns if c.startswith("probability_")]
    return df.withColumn("confidence", F.greatest(*columns))
