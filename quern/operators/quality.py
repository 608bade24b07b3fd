"""Validation, profiles and the structural audit of comment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import flags, punctuation_only, py_strip, text_key, url_only
from quern.labels import LABELS
from quern.sources.tables import with_row_number

REQUIRED = ("id", "post_id", "text", "label")


def _blank(name: str) -> Column:
    return F.coalesce(py_strip(F.col(name)), F.lit("")) == ""


def repeated(df: DataFrame, key: Column) -> DataFrame:
    """The rows whose key occurs more than once, all of them.

    The keys are counted with partial sums and joined back, so a hot key is split by the adaptive
    skew join instead of filling a window.
    """
    keyed = df.withColumn("_key", key)
    often = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    return keyed.join(often, "_key", "left_semi").drop("_key")


def violations(df: DataFrame, labelled: bool = True, labels: Sequence[str] = LABELS) -> DataFrame:
    """(rule, id, detail): every broken rule of a comment table.

    Rules: missing_column, blank_<column>, replacement_character, edge_space_<id>,
    unknown_label, duplicate_id, duplicate_text. A table without rows breaks the rule empty.
    NULL counts as blank; extra columns are ignored.
    """
    spark = df.sparkSession
    required = REQUIRED if labelled else ("id", "text")
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([("missing_column", None, c) for c in missing], "rule string, id string, detail string")
    src = df.select(*[F.col(c).cast("string").alias(c) for c in required])
    rules = [(f"blank_{c}", _blank(c), F.lit(None).cast("string")) for c in required]
    rules.append(("replacement_character", F.contains(F.col("text"), F.lit("�")), F.lit(None).cast("string")))
    for c in ("id", "post_id") if labelled else ("id",):
        rules.append((f"edge_space_{c}", py_strip(F.col(c)) != F.col(c), F.col(c)))
    if labelled:
        rules.append(("unknown_label", ~F.col("label").isin(*labels), F.col("label")))
    per_row = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for name, cond, detail in rules]))
    out = src.select("id", F.explode(per_row).alias("v")).select("v.rule", "id", "v.detail")
    out = out.unionByName(repeated(src, F.col("id")).select(F.lit("duplicate_id").alias("rule"), "id", F.lit(None).cast("string").alias("detail")))
    out = out.unionByName(repeated(src, text_key(F.col("text"))).select(F.lit("duplicate_text").alias("rule"), "id", F.lit(None).cast("string").alias("detail")))
    empty = src.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("detail"))
    return out.unionByName(empty)


def assert_valid(df: DataFrame, labelled: bool = True) -> DataFrame:
    """The table itself; a ValueError names the first broken rules."""
    bad = violations(df, labelled).limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: id={r.id} {r.detail or ''}".strip() for r in bad))
    return df


def statistics(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: rows, posts, and the number of rows of each label (0 where there are none)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("post_id").alias("posts"), *[F.count_if(F.coalesce(F.col("label") == x, F.lit(False))).alias(f"n_{x}") for x in labels])


def label_by_group(df: DataFrame, group: str = "post_id", labels: Sequence[str] = LABELS) -> DataFrame:
    """Contingency table (group, one column per label); labels outside the list count nowhere, NULL is a group."""
    return df.groupBy(group).agg(*[F.count_if(F.coalesce(F.col("label") == x, F.lit(False))).alias(x) for x in labels])


def profile(df: DataFrame, columns: Sequence[str] = ("id", "post_id", "text", "source_id", "source_url"), when: str = "collected_at") -> DataFrame:
    """One row: rows, distinct ids, rows that repeat an id, posts, blank counts per column, first and last time as text."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("id").alias("ids"),
        (F.count(F.lit(1)) - F.countDistinct("id")).alias("duplicate_id_rows"),
        F.countDistinct(F.when(~_blank("post_id"), F.col("post_id"))).alias("posts"),
        *[F.count_if(_blank(c)).alias(f"missing_{c}") for c in columns],
        F.min(when).alias("first_collected"),
        F.max(when).alias("last_collected"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column; NULL is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(flag, n): texts with each quality flag."""
    return df.select(F.explode(flags(F.coalesce(F.col(text), F.lit("")))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def split_profile(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(metric, value) of a labelled table: rows, nulls per column, label counts, labels outside the list, repeated texts, posts."""
    clean = F.lower(py_strip(F.col("label")))
    metrics = {"rows": F.count(F.lit(1)), "posts": F.countDistinct("post_id"), "repeated_texts": F.count("text") - F.countDistinct("text")}
    metrics |= {f"null_{c}": F.count_if(F.col(c).isNull()) for c in ("id", "post_id", "text", "label")}
    metrics |= {f"label_{x}": F.count_if(F.coalesce(clean == x, F.lit(False))) for x in labels}
    metrics["label_other"] = F.count_if(F.coalesce(~clean.isin(*labels), F.lit(True)))
    one = df.agg(*[v.alias(k) for k, v in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("bigint").alias("value")) for k in metrics])
    return one.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def audit(df: DataFrame, seq: str = "seq", file_hash: Column | None = None) -> DataFrame:
    """Every row with its quality flags and reasons for exclusion (an empty array for clean rows).

    Adds source_comment_id, id_origin, audit_flags and reasons. Rows without an id get an internal
    one made of the file's hash and the row's place. Reasons: empty_text,
    identifier_whitespace_requires_source_correction, duplicate_id or conflicting_id (compared
    with the row before of the same id), url_only, punctuation_only_no_sentiment_evidence. If any
    row of an id conflicts, its otherwise clean rows are excluded as conflicting_id as well. NULL
    counts as ''. Rows of one id are compared in the order of ``seq``; ids that occur once stay out
    of it.
    """
    base = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("id", "post_id", "text") if c in df.columns})
    if "post_id" not in df.columns:
        base = base.withColumn("post_id", F.lit(""))
    no_id = py_strip(F.col("id")) == ""
    digest = F.sha2(F.concat_ws(":", file_hash if file_hash is not None else F.lit(""), F.col(seq).cast("string")), 256)
    base = base.withColumns(
        {
            "source_comment_id": F.when(no_id, "").otherwise(F.col("id")),
            "id_origin": F.when(no_id, "internal_missing_source_id").otherwise("source"),
            "id": F.when(no_id, F.concat(F.lit("internal:"), F.substring(digest, 1, 20))).otherwise(F.col("id")),
            "audit_flags": flags(F.col("text")),
        }
    )
    content = F.xxhash64("post_id", "text")
    order = base.select("id", F.col(seq).alias("_seq"), content.alias("_c"))
    # the row before of the same id is the one with the number before in the order of id and place, so
    # an id that holds any share of the rows is cut into ranges like all others
    shared = with_row_number(repeated(order, F.col("id")), ["id", "_seq"], name="_n")
    before = shared.select("id", (F.col("_n") + 1).alias("_n"), F.col("_c").alias("_before"))
    marked = shared.join(before, ["id", "_n"], "left")
    marked = marked.select("id", "_seq", F.when(F.col("_before") == F.col("_c"), "duplicate_id").when(F.col("_before") != F.col("_c"), "conflicting_id").alias("_repeat"))
    conflicts = marked.groupBy("id").agg(F.max(F.coalesce(F.col("_repeat") == "conflicting_id", F.lit(False))).alias("_conflict"))
    marked = marked.join(conflicts, "id")
    joined = base.join(marked.withColumnRenamed("_seq", seq), ["id", seq], "left")
    first = F.array_compact(
        F.array(
            F.when(py_strip(F.col("text")) == "", "empty_text"),
            F.when((py_strip(F.col("id")) != F.col("id")) | (py_strip(F.col("post_id")) != F.col("post_id")), "identifier_whitespace_requires_source_correction"),
            F.col("_repeat"),
            F.when(url_only(F.col("text")), "url_only"),
            F.when(punctuation_only(F.col("text")), "punctuation_only_no_sentiment_evidence"),
        )
    )
    reasons = F.when((F.size("_own") == 0) & F.coalesce("_conflict", F.lit(False)), F.array(F.lit("conflicting_id"))).otherwise(F.col("_own"))
    return joined.withColumn("_own", first).withColumn("reasons", reasons).drop("_own", "_repeat", "_conflict")


def flag_near(audited: DataFrame, pairs: DataFrame) -> DataFrame:
    """The audited rows; those whose id is in a pair (id_a, id_b) have the flag near_duplicate_candidate as well."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("_near", F.lit(True))
    joined = audited.join(ends, "id", "left")
    more = F.when(F.col("_near"), F.array_union("audit_flags", F.array(F.lit("near_duplicate_candidate")))).otherwise(F.col("audit_flags"))
    return joined.withColumn("audit_flags", more).select(*audited.columns)


def audit_report(audited: DataFrame) -> DataFrame:
    """(kind, value, n): rows, clean and excluded ones, and the rows of each flag and of each reason."""
    flag = F.transform("audit_flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("value")))
    reason = F.transform("reasons", lambda x: F.struct(F.lit("reason").alias("kind"), x.alias("value")))
    state = F.when(F.size("reasons") == 0, "clean").otherwise("excluded")
    rows = F.array(F.struct(F.lit("rows").alias("kind"), F.lit("all").alias("value")), F.struct(F.lit("rows").alias("kind"), state.alias("value")))
    return audited.select(F.explode(F.concat(rows, flag, reason)).alias("r")).groupBy("r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def clean_rows(audited: DataFrame) -> DataFrame:
    return audited.where(F.size("reasons") == 0).drop("reasons")


def excluded_rows(audited: DataFrame) -> DataFrame:
    out = audited.where(F.size("reasons") > 0)
    return out.withColumns({"exclusion_reason": F.array_join("reasons", ";"), "exclusion_stage": F.lit("structural_audit")}).drop("reasons")


def origins_invalid(df: DataFrame) -> DataFrame:
    """Rows whose label source and status don't fit: neither (ai, ai_labeled) nor a confirmed human label with a reviewer."""
    ai = (F.col("label_source") == "ai") & (F.col("annotation_status") == "ai_labeled")
    human = (F.col("annotation_status") == "human_confirmed") & (F.col("label_source") != "ai") & ~_blank("label_source") & ~_blank("reviewer")
    return df.where(~F.coalesce(ai, F.lit(False)) & ~F.coalesce(human, F.lit(False)))


def reconcile(raw: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(id, problem): ids that are not exactly once in one of the parts, or whose post_id or text was changed there."""
    union = None
    for name, p in parts.items():
        one = p.select("id", "post_id", "text", F.lit(name).alias("destination"))
        union = one if union is None else union.unionByName(one)
    here = union.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("post_id", "text")).alias("h"))
    there = raw.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("post_id", "text")).alias("g"))
    both = there.join(here, "id", "full")
    problem = F.when(F.col("m").isNull(), "not_in_source").when(F.col("n").isNull(), "lost").when((F.col("n") > 1) | (F.col("m") > 1), "repeated").when(F.col("h") != F.col("g"), "changed")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")
