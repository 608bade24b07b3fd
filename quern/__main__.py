"""Command line: python -m quern COMMAND ...

Commands work on tables: CSV or JSON exports, or parquet folders. Errors in data or arguments end
with a message and exit status 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    from quern.sources.tables import read_csv

    return read_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def show(df: DataFrame) -> None:
    for line in df.toJSON().collect():  # reports of a few rows
        print(line)


def validate(spark, a):
    from quern.operators.quality import assert_valid, statistics

    show(statistics(assert_valid(read(spark, a.input), not a.unlabelled)))


def profile(spark, a):
    from quern.operators.quality import profile as p

    show(p(read(spark, a.input)))


def collect(spark, a):
    from quern.sources.tables import map_columns, read_export, with_row_number
    from quern.streaming.ingest import import_batch

    mapping = {c: c for c in ("id", "post_id", "text")} | dict(m.split("=", 1) for m in a.column)
    rows = map_columns(read_export(spark, a.input, sorted(set(mapping.values()))), mapping)
    numbered = with_row_number(rows.withColumn("_place", F.monotonically_increasing_id()), ["_place"]).drop("_place")
    print(json.dumps(import_batch(spark, numbered, a.output, a.batch)))


def audit(spark, a):
    from quern.operators.quality import audit as run
    from quern.operators.quality import clean_rows, excluded_rows
    from quern.sources.tables import with_row_number

    rows = with_row_number(read(spark, a.input).withColumn("_place", F.monotonically_increasing_id()), ["_place"]).drop("_place")
    out = run(rows)
    clean_rows(out).write.parquet(f"{a.output}/clean")
    excluded_rows(out).write.parquet(f"{a.output}/excluded")


def split(spark, a):
    from quern.operators.split import check_disjoint, grouped_split
    from quern.sources.tables import dataset_hash, save_splits

    rows = read(spark, a.input)
    out = check_disjoint(grouped_split(rows, a.group, tuple(a.ratios), a.seed, a.attempts))
    print(json.dumps(save_splits(out, a.output, dataset_hash(rows), {"seed": a.seed, "ratios": a.ratios, "attempts": a.attempts}), ensure_ascii=False))


def train(spark, a):
    from quern.operators.models import save_pipeline, search
    from quern.sources.tables import load_splits

    rows, manifest = load_splits(spark, a.input)
    found = search(rows.where("split = 'train'"), rows.where("split = 'validation'"), a.feature, a.algorithm, about={"split_manifest_sha256": manifest["manifest_sha256"]})
    save_pipeline(found.best, a.output)
    print(json.dumps(found.log))


def predict(spark, a):
    from quern.operators.models import load_pipeline, predictions
    from quern.sources.tables import literal

    rows = literal(spark, a.text) if a.text is not None else read(spark, a.input)
    p = load_pipeline(spark, a.model)
    out = predictions(rows, p.predict(rows), p.name)
    if a.output:
        out.write.parquet(a.output)
    else:
        show(out)


def evaluate(spark, a):
    from quern.operators.evaluate import evaluation_tables

    for name, df in evaluation_tables(read(spark, a.input)).items():
        df.write.parquet(f"{a.output}/{name}")


def compare(spark, a):
    from functools import reduce

    from quern.operators.evaluate import compare as run

    show(run(reduce(DataFrame.unionByName, [read(spark, p) for p in a.input])))


def assign(spark, a):
    from quern.operators.annotate import assign as run
    from quern.operators.annotate import sample_rows

    rows = read(spark, a.input)
    run(rows, a.people, sample_rows(rows, a.cross, a.seed + 1), sample_rows(rows, a.common, a.seed), a.seed).write.parquet(a.output)


def merge(spark, a):
    from quern.operators import annotate, review

    votes, tasks = read(spark, a.votes), read(spark, a.assignments)
    merged = annotate.merge_votes(votes, tasks)
    if a.resolutions:
        merged = annotate.adjudicate(merged, read(spark, a.resolutions))
    issues = annotate.vote_issues(tasks, votes, read(spark, a.input))
    report, labels = review.release(merged, votes, issues, a.pairs, a.least_agreement)
    merged.write.parquet(f"{a.output}/merged")
    if labels is not None:
        labels.write.parquet(f"{a.output}/labels")
    print(json.dumps(report, ensure_ascii=False))


def _decided(spark, a):
    from quern.operators import review
    from quern.sources.tables import dataset_hash, exists, read_decisions

    base = read(spark, a.input)
    digest = dataset_hash(base, ["seq", "id", "text"])
    found = read_decisions(spark, a.decisions, digest) if exists(spark, a.decisions) else None
    none = spark.createDataFrame([], "seq bigint, suggested_label string, review_priority string, reason string, action string")
    return base, digest, review.by_seq(base, none if found is None else found)


def view(spark, a):
    from quern.operators import review

    base, _, decided = _decided(spark, a)
    show(review.view(base, decided, a.start, a.size))


def record(spark, a):
    from datetime import datetime, timezone

    from quern.operators import review

    base, digest, _ = _decided(spark, a)
    print(review.record(base, read(spark, a.batch), a.decisions, digest, datetime.now(timezone.utc).isoformat()))


def export(spark, a):
    from quern.operators import review

    base, _, decided = _decided(spark, a)
    suggested = review.suggestions(base, decided)
    for name, df in {"label_suggestions": suggested, "review_required": review.required(suggested), "unprocessed_comments": review.unprocessed(suggested), "review_sample": review.sample(suggested), "excluded_comments": review.excluded(base, decided)}.items():
        df.write.parquet(f"{a.output}/{name}")
    show(review.progress(base, decided))


def dataset(spark, a):
    from quern.operators.split import split_dataset
    from quern.sources.tables import dataset_hash, save_splits

    rows = read(spark, a.input)
    out = split_dataset(rows, read(spark, a.all_rows) if a.all_rows else rows, read(spark, a.pairs), seed=a.seed)
    print(json.dumps(save_splits(out, a.output, dataset_hash(rows), {"seed": a.seed}), ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *args):
        c = sub.add_parser(f.__name__)
        for names, options in args:
            c.add_argument(*names, **options)
        c.set_defaults(run=f)

    inp, out = (("--input",), {"required": True}), (("--output",), {"required": True})
    command(validate, inp, (("--unlabelled",), {"action": "store_true"}))
    command(profile, inp)
    command(collect, inp, out, (("--batch",), {"required": True}), (("--column",), {"action": "append", "default": [], "help": "id=source_name"}))
    command(audit, inp, out)
    command(split, inp, out, (("--group",), {"default": "post_id"}), (("--ratios",), {"nargs": 3, "type": float, "default": [0.7, 0.15, 0.15]}), (("--seed",), {"type": int, "default": 42}), (("--attempts",), {"type": int, "default": 512}))
    command(train, inp, out, (("--feature",), {"default": "tfidf", "choices": ["bow", "tfidf", "tfidf_word_char"]}), (("--algorithm",), {"default": "svm", "choices": ["nb", "svm"]}))
    command(predict, (("--input",), {}), (("--text",), {}), (("--model",), {"required": True}), (("--output",), {}))
    command(evaluate, inp, out)
    seed = (("--seed",), {"type": int, "default": 42})
    command(compare, (("--input",), {"required": True, "nargs": "+"}))
    command(assign, inp, out, seed, (("--people",), {"type": int, "default": 4}), (("--cross",), {"type": int, "default": 0}), (("--common",), {"type": int, "default": 40}))
    command(merge, inp, out, (("--votes",), {"required": True}), (("--assignments",), {"required": True}), (("--resolutions",), {}), (("--pairs",), {"type": int, "required": True}), (("--least-agreement",), {"type": float, "default": 0.8}))
    decisions = (("--decisions",), {"required": True})
    command(view, inp, decisions, (("--start",), {"type": int, "required": True}), (("--size",), {"type": int, "default": 50}))
    command(record, inp, decisions, (("--batch",), {"required": True}))
    command(export, inp, decisions, out)
    command(dataset, inp, out, seed, (("--pairs",), {"required": True}), (("--all-rows",), {}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quern {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.run(spark, a)
    except Exception as e:  # one line for the user; Spark's own log has the rest
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
