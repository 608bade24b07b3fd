"""Assigning annotation tasks, merging independent votes, agreement, and reviewed decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import py_strip
from quern.labels import LABELS
from quern.operators.prefix import running_sum

TASK_FIELDS = ("id", "post_id", "text", "role", "label", "annotation_status", "reviewer", "context_used", "notes")
PARTS = 4096


def shuffled(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """The rows with ``place``: their place from 0 in an order by hash, the same for the same seed."""
    h = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 1))
    return running_sum(h, [], ["_h", id_col], F.shiftright("_h", 51).cast("int"), F.lit(1), "place").drop("_h")


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows chosen by hash, without replacement; all rows if there are fewer."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def stratified_sample(df: DataFrame, by: str = "label", n: int = 30, seed: int = 42, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """Up to n rows for each value of ``by``, chosen by hash.

    A value may hold any share of the rows: each of PARTS parts of a value keeps its first n, and
    those compete.
    """
    src = df if where is None else df.where(where)
    src = src.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    first = Window.partitionBy(by, F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(PARTS))).orderBy("_h", id_col)
    some = src.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", id_col)))
    return some.where(F.col("_r") <= n).drop("_h", "_r")


def assign(df: DataFrame, people: int = 4, cross: DataFrame | None = None, common: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(id, person, role): one primary person for each id, round robin over a shuffled order.

    The ids of ``cross`` get a second person with the role cross_check, those of ``common`` all
    people (role common besides the primary one). Persons count from 1.
    """
    rows = shuffled(df.select("id").distinct(), seed)
    mark = lambda t: t.select("id").distinct().withColumn("_in", F.lit(True)) if t is not None else df.select("id").limit(0).withColumn("_in", F.lit(True))
    rows = rows.join(mark(cross).withColumnRenamed("_in", "cross"), "id", "left").join(mark(common).withColumnRenamed("_in", "common"), "id", "left")
    primary = (F.col("place") % people + 1).cast("int")
    second = ((primary - 1 + F.col("place") % max(1, people - 1) + 1) % people + 1).cast("int")
    task = lambda person, role: F.struct(person.alias("person"), role.alias("role"))
    everyone = F.transform(F.sequence(F.lit(1), F.lit(people)), lambda p: task(p, F.when(p == primary, "primary").otherwise("common")))
    tasks = F.when(F.col("common"), everyone).when(F.col("cross"), F.array(task(primary, F.lit("primary")), task(second, F.lit("cross_check")))).otherwise(F.array(task(primary, F.lit("primary"))))
    return rows.select("id", F.explode(tasks).alias("t")).select("id", "t.person", "t.role")


def task_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("person").agg(F.count(F.lit(1)).alias("n_tasks"))


def vote_valid(labels: Sequence[str] = LABELS) -> Column:
    return F.coalesce(F.col("label").isin(*labels) & (F.col("annotation_status") == "human_confirmed") & (py_strip(F.col("reviewer")) != ""), F.lit(False))


def vote_issues(assignments: DataFrame, votes: DataFrame, base: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, person, issue): missing_row, out_of_assignment, changed_field, invalid_label, invalid_status, confirmed_without_reviewer, confirmed_without_label."""
    key = ["id", "person"]
    missing = assignments.join(votes, key, "left_anti").select(*key, F.lit("missing_row").alias("issue"))
    outside = votes.join(assignments, key, "left_anti").select(*key, F.lit("out_of_assignment").alias("issue"))
    fixed = base.select("id", F.col("post_id").alias("_post"), F.col("text").alias("_text"))
    both = votes.join(assignments.withColumnRenamed("role", "_role"), key).join(fixed, "id")
    confirmed = F.col("annotation_status") == "human_confirmed"
    rules = [
        ("changed_field", ~(F.col("post_id").eqNullSafe(F.col("_post")) & F.col("text").eqNullSafe(F.col("_text")) & F.col("role").eqNullSafe(F.col("_role")))),
        ("invalid_label", ~F.col("label").isin("", *labels)),
        ("invalid_status", ~F.col("annotation_status").isin("pending_review", "human_confirmed")),
        ("confirmed_without_reviewer", confirmed & (F.coalesce(py_strip(F.col("reviewer")), F.lit("")) == "")),
        ("confirmed_without_label", confirmed & (F.coalesce(F.col("label"), F.lit("")) == "")),
    ]
    found = both.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("issue"))
    return missing.unionByName(outside).unionByName(found)


def merge_votes(votes: DataFrame, assignments: DataFrame | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, n_votes, complete, unanimous, label, issue_reason): the state of every id; there is no majority vote.

    complete: all assigned people voted and all votes are valid; unanimous: complete with one
    label, which is then the label. issue_reason is disagreement or
    missing_invalid_or_unconfirmed for the others. Without assignments the votes at hand are
    those expected.
    """
    per_id = votes.withColumn("_ok", vote_valid(labels)).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_votes"), F.bool_and("_ok").alias("all_ok"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    if assignments is not None:
        expected = assignments.groupBy("id").agg(F.count(F.lit(1)).alias("expected"))
        per_id = expected.join(per_id, "id", "left").na.fill(0, ["n_votes"])
        complete = F.coalesce(F.col("all_ok"), F.lit(False)) & (F.col("n_votes") == F.col("expected"))
    else:
        complete = F.col("all_ok")
    per_id = per_id.withColumn("complete", complete).withColumn("unanimous", F.col("complete") & (F.col("lo") == F.col("hi")))
    reason = F.when(~F.col("unanimous"), F.when(F.col("complete"), "disagreement").otherwise("missing_invalid_or_unconfirmed"))
    return per_id.select("id", "n_votes", "complete", "unanimous", F.when(F.col("unanimous"), F.col("lo")).alias("label"), reason.alias("issue_reason"))


def adjudicate(merged: DataFrame, resolutions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """merged with resolutions (id, final_label, annotation_status, reviewer, reason): only complete disagreements may be resolved.

    Adds label_source. A resolution of another id, or one that is not confirmed with reviewer and
    reason, is an error.
    """
    good = F.col("final_label").isin(*labels) & (F.col("annotation_status") == "human_confirmed") & (py_strip(F.col("reviewer")) != "") & (py_strip(F.col("reason")) != "")
    res = resolutions.select("id", F.col("final_label"), F.coalesce(good, F.lit(False)).alias("_good"))
    joined = merged.join(res, "id", "left")
    wrong = res.join(merged.where("issue_reason = 'disagreement'"), "id", "left_anti")
    if wrong.limit(1).count() or res.where("NOT _good").limit(1).count() or res.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("resolutions must be confirmed, one for each id, and of complete disagreements only")
    source = F.when(F.col("final_label").isNotNull(), "human_adjudication").when(F.col("label").isNotNull(), "human_unanimous_confirmation")
    return joined.withColumns({"label_source": source, "label": F.coalesce("final_label", "label")}).drop("final_label", "_good")


def reviewed(base: DataFrame, merged: DataFrame) -> DataFrame:
    """The base rows with the confirmed label ('' if none) and annotation_status."""
    m = merged.where("label IS NOT NULL").select("id", F.col("label").alias("_label"))
    out = base.drop("label", "annotation_status").join(m, "id", "left")
    status = F.when(F.col("_label").isNotNull(), "human_confirmed").otherwise("pending_review")
    return out.withColumns({"annotation_status": status, "label": F.coalesce("_label", F.lit(""))}).drop("_label")


def unanimity(merged: DataFrame) -> DataFrame:
    """One row: complete ids with more than one vote, and the share of them that are unanimous (NULL if there are none)."""
    several = merged.where("complete AND n_votes > 1")
    return several.agg(F.count(F.lit(1)).alias("n_complete"), F.avg(F.col("unanimous").cast("double")).alias("unanimous_share"))


def vote_pairs(votes: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, a, b): the two labels of ids with exactly two valid votes, in the order of the roles primary and cross_check (then reviewer)."""
    ok = votes.where(vote_valid(labels)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("role") != "primary", "reviewer", "label")).alias("x"), F.max(F.struct(F.col("role") != "primary", "reviewer", "label")).alias("y"))
    return ok.where("n = 2").select("id", F.col("x.label").alias("a"), F.col("y.label").alias("b"))


def pair_agreement(pairs: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: n_pairs, agreement (share of equal pairs) and Cohen's kappa over (a, b); NULL where undefined."""
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"),
        *[F.avg((F.col(c) == x).cast("double")).alias(f"{c}_{i}") for c in "ab" for i, x in enumerate(labels)],
    )
    chance = sum((F.col(f"a_{i}") * F.col(f"b_{i}") for i in range(1, len(labels))), F.col("a_0") * F.col("b_0"))
    kappa = F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance))
    return sums.select("n_pairs", "agreement", kappa.alias("kappa"))


def label_decisions(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """The base rows with decisions (id, suggested_label, review_priority, reason, action): a human label wins over a suggested one.

    Adds label, label_source, annotation_status (human_confirmed, ai_labeled or unresolved),
    review_priority and reason; rows without a decision are high priority and unresolved, rows
    with the action exclude are left out.
    """
    d = decisions.select("id", F.col("suggested_label").alias("_s"), F.col("review_priority").alias("_p"), F.col("reason").alias("_r"), F.col("action").alias("_a"))
    rows = base.join(d, "id", "left").where(F.coalesce(F.col("_a"), F.lit("keep")) != "exclude")
    col = lambda c: F.col(c) if c in base.columns else F.lit(None).cast("string")
    human = F.coalesce((col("annotation_status") == "human_confirmed") & col("label").isin(*LABELS) & (py_strip(col("reviewer")) != ""), F.lit(False))
    suggested = F.coalesce("_s", F.lit(""))
    return rows.withColumns(
        {
            "label_source": F.when(human, F.coalesce(col("label_source"), F.lit("explicit_human_confirmation_in_input"))).otherwise("ai"),
            "label": F.when(human, col("label")).otherwise(suggested),
            "annotation_status": F.when(human, "human_confirmed").when(suggested != "", "ai_labeled").otherwise("unresolved"),
            "review_priority": F.coalesce("_p", F.lit("high")),
            "reason": F.coalesce("_r", F.lit("not read; no suggestion")),
        }
    ).drop("_s", "_p", "_r", "_a")


def decision_problems(decisions: DataFrame, base: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(id, problem) of a batch of decisions: unknown_id, repeated, label, priority, reason, action, unclear_not_high."""
    rules = [
        ("label", ~F.coalesce(F.col("suggested_label"), F.lit("")).isin("", *labels)),
        ("priority", ~F.coalesce(F.col("review_priority"), F.lit("")).isin("high", "medium", "low")),
        ("reason", F.coalesce(py_strip(F.col("reason")), F.lit("")) == ""),
        ("action", ~F.coalesce(F.col("action"), F.lit("keep")).isin("keep", "exclude")),
        ("unclear_not_high", (F.coalesce(F.col("suggested_label"), F.lit("")) == "") & (F.coalesce(F.col("action"), F.lit("keep")) != "exclude") & (F.col("review_priority") != "high")),
    ]
    found = decisions.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("problem"))
    unknown = decisions.join(base.select("id"), "id", "left_anti").select("id", F.lit("unknown_id").alias("problem"))
    twice = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem"))
    return found.unionByName(unknown).unionByName(twice)
