"""Reviewing suggested labels: decision batches, the tables they lead to, and the gate before labels are released.

A base table has seq, id, post_id, text and audit_flags (joined by ;), and may hold human labels.
Decisions are (seq, suggested_label, review_priority, reason, action); a batch names the hash of
the base it was made for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import flags, py_strip, split_flags
from quern.labels import LABELS
from quern.operators.annotate import decision_problems, pair_agreement, stratified_sample, vote_pairs
from quern.sources import tables

# The columns of the tables that reviewers get, and texts that stand where nothing was read.
SUGGESTION_FIELDS = ("id", "post_id", "text", "suggested_label", "review_priority", "reason", "label", "annotation_status", "ai_processed", "context_used", "audit_flags", "label_source")
UNREAD, CONTEXT, HUMAN_SOURCE = "not read; no suggestion", "comment_only_no_parent_or_post_text", "explicit_human_confirmation_in_input"
LEAST_AGREEMENT = 0.8


def by_seq(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions with the id of the base row that their seq names; an unknown seq is an error."""
    own = decisions.drop("id") if "id" in decisions.columns else decisions
    if unknown := own.join(base.select("seq"), "seq", "left_anti").select("seq").limit(5).collect():
        raise ValueError(f"no such seq: {[r[0] for r in unknown]}")
    return own.join(base.select("seq", "id"), "seq")


def view(base: DataFrame, decided: DataFrame, start: int, size: int) -> DataFrame:
    """The rows start <= seq < start + size that have no decision yet, in order."""
    rows = base.where(F.col("seq").between(start, start + size - 1))
    return rows.join(decided.select("id"), "id", "left_anti").select(*base.columns).orderBy("seq")


def record(base: DataFrame, decisions: DataFrame, folder: str, base_hash: str, made_at: str, method: str = "") -> str:
    """Appends a batch of decisions to a folder and gives the path of its file, batch_0001.json and so on.

    The batch must hold at least one decision, none for an id that has one, and none with the
    problems of :func:`quern.operators.annotate.decision_problems`; it is bounded by what a person
    or model decides at a time, and is written by the driver.
    """
    spark = base.sparkSession
    new = by_seq(base, decisions)
    known = tables.exists(spark, folder)
    if known:
        old = tables.read_decisions(spark, folder, base_hash)
        if twice := new.join(old.select("id"), "id", "left_semi").select("id").limit(5).collect():
            raise ValueError(f"decided before: {[r[0] for r in twice]}")
    if bad := decision_problems(new, base).limit(5).collect():
        raise ValueError("; ".join(f"{r.id}: {r.problem}" for r in bad))
    rows = [r.asDict() for r in new.orderBy("seq").collect()]
    if not rows:
        raise ValueError("a batch needs a decision")
    n = tables.read_decision_files(spark, folder) + 1 if known else 1
    path = f"{folder.rstrip('/')}/batch_{n:04d}.json"
    tables.write_json(spark, path, {"base_sha256": base_hash, "created_at": made_at, "method": method, "decisions": rows})
    return path


def suggestions(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """The base rows that no decision (id, ...) excludes, as reviewers see them (SUGGESTION_FIELDS).

    Rows without a decision are of high priority and unprocessed. A label counts as human only
    with a confirmed status, a valid label and a reviewer; a suggestion never becomes a label.
    """
    d = decisions.select("id", *[F.col(c).alias(f"_{c}") for c in ("suggested_label", "review_priority", "reason", "action")], F.lit(True).alias("_done"))
    rows = base.join(d, "id", "left").where(F.coalesce("_action", F.lit("keep")) != "exclude")
    col = lambda c: F.col(c) if c in base.columns else F.lit(None).cast("string")
    human = F.coalesce((col("annotation_status") == "human_confirmed") & col("label").isin(*LABELS) & (py_strip(col("reviewer")) != ""), F.lit(False))
    return rows.select(
        "id", "post_id", "text",
        F.coalesce("_suggested_label", F.lit("")).alias("suggested_label"),
        F.coalesce("_review_priority", F.lit("high")).alias("review_priority"),
        F.coalesce("_reason", F.lit(UNREAD)).alias("reason"),
        F.when(human, col("label")).otherwise("").alias("label"),
        F.when(human, "human_confirmed").otherwise("pending_review").alias("annotation_status"),
        F.when(F.col("_done"), "yes").otherwise("no").alias("ai_processed"),
        F.lit(CONTEXT).alias("context_used"),
        F.array_join(all_flags(col("audit_flags"), F.col("text")), ";").alias("audit_flags"),
        F.when(human, HUMAN_SOURCE).otherwise("").alias("label_source"),
    )


def all_flags(joined: Column, text: Column) -> Column:
    """The flags of a ;-joined column and those of the text, each once, in order."""
    return F.array_sort(F.array_union(split_flags(joined), flags(F.coalesce(text, F.lit("")))))


def required(suggested: DataFrame) -> DataFrame:
    return suggested.where(F.col("review_priority") == "high")


def unprocessed(suggested: DataFrame) -> DataFrame:
    return suggested.where(F.col("ai_processed") == "no")


def sample(suggested: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """Up to n rows for each suggested label that are not of high priority."""
    return stratified_sample(suggested, "suggested_label", n, seed, where=(F.col("review_priority") != "high") & F.col("suggested_label").isin(*LABELS))


def to_review(suggested: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """(id): the rows of high priority and the sampled ones."""
    return required(suggested).select("id").union(sample(suggested, n, seed).select("id")).distinct()


def excluded(base: DataFrame, decisions: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, exclusion_reason, exclusion_stage): the rows that decisions exclude, after those excluded ``before``."""
    own = decisions.where(F.col("action") == "exclude").join(base.select("id"), "id", "left_semi")
    out = own.select("id", F.col("reason").alias("exclusion_reason"), F.lit("language_review").alias("exclusion_stage"))
    return out if before is None else before.select("id", "exclusion_reason", "exclusion_stage").unionByName(out)


def progress(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """(metric, value): rows, decisions, suggestions and human labels so far."""
    s = suggestions(base, decisions)
    done, suggested, human = F.col("ai_processed") == "yes", F.col("suggested_label") != "", F.col("annotation_status") == "human_confirmed"
    metrics = {
        "valid_rows": F.count(F.lit(1)), "processed_kept_rows": F.count_if(done), "remaining_rows": F.count_if(~done), "suggested_rows": F.count_if(suggested), "processed_without_suggestion": F.count_if(done & ~suggested),
        "review_required_rows": F.count_if(F.col("review_priority") == "high"), "high_priority_processed_rows": F.count_if(done & (F.col("review_priority") == "high")), "human_confirmed_rows": F.count_if(human),
    } | {f"suggested_{x}": F.count_if(F.col("suggested_label") == x) for x in LABELS} | {f"human_{x}": F.count_if(human & (F.col("label") == x)) for x in LABELS}
    one = s.agg(*[c.alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("bigint").alias("value")) for k in metrics])).alias("m")).select("m.*")


def release(merged: DataFrame, votes: DataFrame, issues: DataFrame, planned_pairs: int, least_agreement: float = LEAST_AGREEMENT) -> tuple[dict, DataFrame | None]:
    """(report, labels): labels (id, label) are only given if everything is settled, else None.

    That is: every id of merged has a label, there are no issues, all planned pairs of votes are
    there, and the share of equal ones is at least ``least_agreement``. A lower share asks for a
    look at the rules of labelling, not at single rows.
    """
    if not 0 <= least_agreement <= 1:
        raise ValueError("least_agreement is a share")
    open_ids, n_issues = merged.where("label IS NULL").count(), issues.count()
    pairs = pair_agreement(vote_pairs(votes)).first()
    review = pairs["n_pairs"] != planned_pairs or pairs["agreement"] is None or pairs["agreement"] < least_agreement
    ready = not open_ids and not n_issues and not review
    report = {"status": "confirmed" if ready else "needs_human_review", "unresolved_samples": open_ids, "issues": n_issues, "cross_samples_planned": planned_pairs, "cross_samples_completed": pairs["n_pairs"], "cross_agreement": pairs["agreement"], "pooled_pair_cohen_kappa": pairs["kappa"], "quality_review_required": review}
    return report, merged.select("id", "label") if ready else None


def aligned(a: DataFrame, b: DataFrame, columns: Sequence[str], seq: str = "seq") -> DataFrame:
    """(seq, problem): places at which two tables in one order differ in a column, or that only one of them has."""
    x, y = a.select(seq, F.struct(*columns).alias("_a")), b.select(seq, F.struct(*columns).alias("_b"))
    both = x.join(y, seq, "full")
    problem = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second")
    for c in columns:
        problem = problem.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c)
    return both.select(seq, problem.alias("problem")).where("problem IS NOT NULL")


def false_excerpts(excerpts: DataFrame, rows: DataFrame) -> DataFrame:
    """The excerpts (id, excerpt, ...) that are no part of their row's text, white space aside, or of no row."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    joined = excerpts.join(rows.select("id", F.col("text").alias("_text")), "id", "left")
    return joined.where(~F.coalesce(F.contains(flat(F.col("_text")), flat(F.col("excerpt"))), F.lit(False))).drop("_text")

