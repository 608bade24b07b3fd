"""The queries that the core registers, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.ngrams import char_wb_ngrams, word_ngrams
from quern.labels import LABELS
from quern.operators import annotate, duplicates, encode, evaluate, features, graph, models, quality, review, split
from quern.plans import sql
from quern.sources import raw_records, tables
from quern.streaming import ingest
from quern.workspace import Workspace, table


# A public tokenizer's file; where it lies elsewhere, pass another path to encode.tokenizer_file.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "comments")


def one_per_id(df: DataFrame) -> DataFrame:
    """One row for each id: the first delivered."""
    return df.groupBy("id").agg(F.min_by(F.struct("post_id", "text", "label", "source_id"), F.struct("loaded_at", "source_id", "collected_at")).alias("c")).select("id", "c.*")


def with_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments, one for each id, with a clean post; where there is none, post:<id> if labelled, else ''."""
    post = F.lower(X.py_strip(F.coalesce(F.col("post_id"), F.lit(""))))
    own = (post == "") & F.col("label").isin(*LABELS)
    return one_per_id(comments(spark, sf_dir)).withColumn("post_id", F.when(own, F.concat(F.lit("post:"), "id")).otherwise(post))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled comments, one for each id, with a clean post (post:<id> where there is none)."""
    return with_posts(spark, sf_dir).where(F.col("label").isin(*LABELS))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments with ``seq``, their place by arrival."""
    return tables.with_row_number(comments(spark, sf_dir), ["loaded_at", "id", F.xxhash64("source_id", "collected_at")])


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a fixed emoji rule, to be evaluated."""
    t = F.col("text")
    guess = F.when(t.rlike("[👎😡😢]"), "negative").when(t.rlike("[👍😊😍]"), "positive").otherwise("neutral")
    return labelled(spark, sf_dir).select("id", "post_id", "text", F.col("label").alias("true_label"), guess.alias("predicted_label"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with clean label and reviewer, the latest of each reviewer and id."""
    a = table(spark, sf_dir, "annotations").withColumns({"label": X.clean_label(F.coalesce("label", F.lit(""))), "reviewer": X.clean_label(F.coalesce("reviewer", F.lit("")))})
    last = F.struct("submitted_at", "role", "label", "annotation_status", "notes")
    return a.groupBy("id", "reviewer").agg(F.max(last).alias("v")).select("id", "reviewer", "v.role", "v.label", "v.annotation_status")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled comments with normalized text and the split of the earlier splitting."""
    splits = table(spark, sf_dir, "split_groups").select("id", "split")
    return labelled(spark, sf_dir).join(splits, "id").withColumn("text", X.normalize_text(F.col("text")))


def trained(spark: SparkSession, sf_dir: str, kind: str = "bow", max_features: int = 20_000):
    """(train rows, held-out rows, vocabulary model, training features) in the workspace."""
    work = Workspace(spark, "model")
    rows = work.save(model_rows(spark, sf_dir))
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    fm = features.fit(train, features.Vectorizer(kind, max_features=max_features))
    return train, held, fm, work.save(fm.transform(train))


def naive_bayes(spark: SparkSession, sf_dir: str):
    train, held, fm, x = trained(spark, sf_dir)
    return models.fit_naive_bayes(train, x, fm.vocabulary, 0.5), held, fm


def nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb, held, fm = naive_bayes(spark, sf_dir)
    return nb.predict(held, fm.transform(held)).join(held.select("id", "label"), "id").select("id", F.col("label").alias("true_label"), "predicted_label")


def svm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Workspace(spark, "model").save(model_rows(spark, sf_dir))
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    fm = features.fit(train, features.Vectorizer("tfidf", max_features=20_000), unique=True)
    svm = models.fit_with_retry(train, fm.pack(train, ("label",)), fm.vocabulary, c=1.0)
    return svm.predict_packed(fm.pack(held, ("id", "label")), fm.vocabulary).select("id", F.col("label").alias("true_label"), "predicted_label")


def grid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search log of four naive Bayes candidates."""
    rows = labelled(spark, sf_dir).join(table(spark, sf_dir, "split_groups").select("id", "split"), "id")
    found = models.search(rows.where("split = 'train'"), rows.where("split = 'validation'"), "bow", "nb")
    log = [(r["candidate"], f"{r['ngram'][0]}-{r['ngram'][1]}", float(r["param"]), round(float(r["validation_macro_f1"]), 9), r["candidate"] == found.best.settings["candidate"]) for r in found.log]
    return spark.createDataFrame(log, "candidate int, ngram string, param double, validation_macro_f1 double, best boolean")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier splitting with texts."""
    s = table(spark, sf_dir, "split_groups").select("id", "split", "split_component")
    return s.join(one_per_id(comments(spark, sf_dir)).select("id", "post_id", "text", "label"), "id")


def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates with both ends, without blanks around ids, each pair once."""
    a, b = X.py_strip(F.col("id_a")), X.py_strip(F.col("id_b"))
    p = table(spark, sf_dir, "near_duplicates").select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    return p.where("id_a <> '' AND id_b <> '' AND id_a <> id_b").distinct()


def post_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of labelled comments; near duplicates link them through any comment, labelled or not."""
    return graph.connected_posts(labelled(spark, sf_dir), with_posts(spark, sf_dir), clean_pairs(spark, sf_dir))


def term_totals(spark: SparkSession, sf_dir: str, terms: Column) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.explode(terms).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def bow_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent words with their document frequencies."""
    fm = features.fit(labelled(spark, sf_dir), features.Vectorizer("bow", max_features=100))
    return fm.vocabulary.select("term", F.col("df").cast("bigint").alias("df"), F.col("total").cast("bigint").alias("total"))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    fm = features.fit(rows, features.Vectorizer("tfidf"))
    return fm.transform(rows).select("id", "term", F.round("value", 6).alias("value"))


def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, n_terms) of the word and character vocabulary, fitted on train only."""
    train = model_rows(spark, sf_dir).where("split = 'train'")
    fm = features.fit(train, features.Vectorizer("tfidf_word_char", char_max_features=20_000))
    return fm.vocabulary.groupBy(F.when(F.col("part") == 0, "word").otherwise("char").alias("part")).agg(F.count(F.lit(1)).alias("n_terms"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_per_id(comments(spark, sf_dir))
    return annotate.assign(rows, 4, annotate.stratified_sample(rows.where(F.col("label").isin(*LABELS)), "label", 30), annotate.sample_rows(rows, 40, 42))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit(numbered(spark, sf_dir)).select("seq", "id_origin", F.array_join("audit_flags", ";").alias("audit_flags"), F.array_join("reasons", ";").alias("reasons"))


def near_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_near(quality.audit(numbered(spark, sf_dir)), clean_pairs(spark, sf_dir))


def review_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id with seq; comments with a label count as confirmed by their source."""
    rows = one_per_id(comments(spark, sf_dir)).withColumns({"reviewer": F.col("source_id"), "audit_flags": F.lit("")})
    rows = rows.withColumn("annotation_status", F.when(F.col("label").isin(*LABELS), "human_confirmed"))
    return tables.with_row_number(rows, ["id"])


def review_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The base, and decisions by a fixed rule for all its rows that have a post."""
    base = Workspace(spark, "review").save(review_base(spark, sf_dir))
    t = F.coalesce("text", F.lit(""))
    guess = F.when(t.rlike("[👎😡😢]"), "negative").when(t.rlike("[👍😊😍]"), "positive").when(F.length(t) > 200, "neutral").otherwise("")
    rows = base.where(X.py_strip(F.coalesce(F.col("post_id"), F.lit(""))) != "").select("seq", guess.alias("suggested_label"), X.url_only(t).alias("link"))
    decisions = rows.select("seq", "suggested_label", F.when(F.col("suggested_label") == "", "high").otherwise("low").alias("review_priority"), F.lit("rule").alias("reason"), F.when(F.col("link"), "exclude").otherwise("keep").alias("action"))
    return base, review.by_seq(base, decisions)


def reviewed_rows(pick):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(review.suggestions(*review_decisions(spark, sf_dir))).select("id", "suggested_label", "review_priority", "label", "annotation_status", "ai_processed", "audit_flags", "label_source")

    return run


def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the release gate over all votes."""
    v = votes(spark, sf_dir)
    none = spark.createDataFrame([], "id string, issue string")
    r, _ = review.release(annotate.merge_votes(v), v, none, 0)
    row = (r["status"], r["unresolved_samples"], r["cross_samples_completed"], r["cross_agreement"], r["quality_review_required"])
    return spark.createDataFrame([row], "status string, unresolved_samples bigint, cross_samples_completed bigint, cross_agreement double, quality_review_required boolean").withColumn("cross_agreement", F.round("cross_agreement", 9))


def capture_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delivered rows against the labelled comments, one for each id."""
    rows = comments(spark, sf_dir).select("id", F.coalesce("post_id", F.lit("")).alias("post_id"), F.coalesce("text", F.lit("")).alias("text"))
    main = one_per_id(comments(spark, sf_dir)).where(F.col("label").isin(*LABELS)).select("id", F.coalesce("post_id", F.lit("")).alias("post_id"), F.coalesce("text", F.lit("")).alias("text"))
    return duplicates.historical_duplicates(rows, main).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("canonical_id").alias("n_canonical"))


def _zero_filled(spark: SparkSession, rules: list[str], found: DataFrame) -> DataFrame:
    names = spark.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken")), "rule", "left").na.fill(0, ["n_broken"])


def grouped_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, n_broken) of grouped_split: posts in two splits, labels a split lacks, shares off by more than 0.05."""
    rows = Workspace(spark, "splitcheck").save(split.grouped_split(labelled(spark, sf_dir)).select("id", "post_id", "label", "split"))
    apart = split.broken_groups(rows, "post_id").select(F.lit("post_in_two_splits").alias("rule"))
    lacking = split.missing_labels(rows).select(F.lit("label_missing").alias("rule"))
    want = F.create_map(*[F.lit(x) for kv in zip(split.SPLIT_NAMES, split.RATIOS) for x in kv])
    off = rows.groupBy("split").agg((F.count(F.lit(1)) / F.lit(rows.count())).alias("share")).where(F.abs(F.col("share") - F.try_element_at(want, F.col("split"))) > 0.05)
    return _zero_filled(spark, ["post_in_two_splits", "label_missing", "share_off"], apart.unionByName(lacking).unionByName(off.select(F.lit("share_off").alias("rule"))))


def assignment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, n_broken) of assignments: ids without exactly one primary person, persons twice at an id, uneven primary loads, ids without any task, ids with a number of tasks other than 1, 2 and 4."""
    a = Workspace(spark, "assigncheck").save(assignments(spark, sf_dir))
    per = a.groupBy("id").agg(F.count_if(F.col("role") == "primary").alias("p"), F.count(F.lit(1)).alias("n"), F.countDistinct("person").alias("k"))
    loads = a.where("role = 'primary'").groupBy("person").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") - F.min("n")).alias("d")).where("d > 1")
    ids = one_per_id(comments(spark, sf_dir)).select("id")
    rules = {"one_primary": per.where("p <> 1"), "person_twice": per.where("k <> n"), "uneven": loads, "without_task": ids.join(a.select("id"), "id", "left_anti"), "odd_number": per.where("n NOT IN (1, 2, 4)")}
    found = None
    for name, df in rules.items():
        one = df.select(F.lit(name).alias("rule"))
        found = one if found is None else found.unionByName(one)
    return _zero_filled(spark, list(rules), found)


def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, terms, stored entries and rows without features of the held-out rows under the training vocabulary."""
    _, held, fm, _ = trained(spark, sf_dir)
    return features.matrix_profile(held, fm.transform(held))


def ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.judge(numbered(spark, sf_dir)).select("seq", "id", "state", "reason")


def _arrived() -> Column:
    """Arrival in microseconds, which reads the same in every time zone."""
    return F.unix_micros("loaded_at").alias("loaded_us")


def metrics_of(f):
    return lambda s, d: f(rule_predictions(s, d))


def queries() -> dict:
    # columns are made when a query runs, as they need a session
    return {
        "p5_found": lambda s, d: raw_records.rejected_rows(table(s, d, "raw_rows")),
        "p5_loaded": lambda s, d: raw_records.loaded_rows(table(s, d, "raw_rows")),
        "p5_reasons": lambda s, d: raw_records.rejected_rows(table(s, d, "raw_rows")).groupBy("file_key", "reason").agg(F.count(F.lit(1)).alias("n")),
        # validation and profiles
        "exact_duplicate_groups": lambda s, d: duplicates.duplicate_groups(comments(s, d)),
        "first_canonical": lambda s, d: duplicates.first_canonical(numbered(s, d)),
        "duplicate_id_rows": lambda s, d: quality.repeated(comments(s, d), F.col("id")).select("id", _arrived()),
        "violations": lambda s, d: quality.violations(comments(s, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n")),
        "label_statistics": lambda s, d: quality.statistics(comments(s, d)),
        "label_by_post": lambda s, d: quality.label_by_group(comments(s, d)),
        "comment_profile": lambda s, d: quality.profile(comments(s, d)),
        "source_counts": lambda s, d: quality.value_counts(comments(s, d), "source_id"),
        "quality_flag_counts": lambda s, d: quality.flag_counts(comments(s, d)),
        "split_file_profile": lambda s, d: quality.split_profile(comments(s, d)),
        "audit": audited,
        "audit_report": lambda s, d: quality.audit_report(near_flagged(s, d)),
        "ingest_states": ingest_states,
        "capture_relationships": capture_relationships,
        # review
        "review_suggestions": reviewed_rows(lambda x: x),
        "review_required": reviewed_rows(review.required),
        "review_unprocessed": reviewed_rows(review.unprocessed),
        "review_excluded": lambda s, d: review.excluded(*review_decisions(s, d)),
        "review_progress": lambda s, d: review.progress(*review_decisions(s, d)),
        "review_view": lambda s, d: review.view(review_base(s, d), review_decisions(s, d)[1], 1, 1000).select("seq", "id"),
        "release_report": release_report,
        "row_hashes": lambda s, d: comments(s, d).select("id", _arrived(), tables.row_hash(["id", "post_id", "text", "label"]).alias("row_sha256")),
        # text
        "text_keys": lambda s, d: comments(s, d).select("id", _arrived(), X.text_key(F.col("text")).alias("text_key")),
        "basic_normalized": lambda s, d: comments(s, d).select("id", _arrived(), X.basic_normalize(F.col("text")).alias("text")),
        "normalized_texts": lambda s, d: comments(s, d).select("id", _arrived(), X.normalize_text(F.col("text")).alias("text")),
        "normalized_emoji_mapped": lambda s, d: comments(s, d).select("id", _arrived(), X.normalize_text(F.col("text"), emoji_mode="map").alias("text")),
        "redacted_texts": lambda s, d: comments(s, d).select("id", _arrived(), X.redact_sensitive(F.col("text")).alias("text")),
        "replaced_urls": lambda s, d: comments(s, d).select("id", _arrived(), X.replace_urls(F.col("text")).alias("text")),
        "expanded_slang": lambda s, d: comments(s, d).select("id", _arrived(), X.expand_slang(F.lower("text")).alias("text")),
        "stopped_texts": lambda s, d: comments(s, d).select("id", _arrived(), X.preprocess(F.col("text"), stop_words=["là", "thì", "mà"]).alias("text")),
        "redacted_previews": lambda s, d: comments(s, d).select("id", _arrived(), X.redact_preview(F.col("text")).alias("text")),
        "word_counts": lambda s, d: comments(s, d).select("id", _arrived(), X.word_count(F.col("text")).alias("n_words")),
        "text_slices": lambda s, d: comments(s, d).select(F.explode(X.slices(F.col("text"))).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n")),
        # features and models
        "bow_top_terms": bow_top_terms,
        "bigram_counts": lambda s, d: term_totals(s, d, F.filter(word_ngrams(X.tokens(F.col("text")), (1, 2)), lambda g: F.contains(g, F.lit(" ")))),
        "trigram_total": lambda s, d: labelled(s, d).agg(F.sum(F.size(word_ngrams(X.tokens(F.col("text")), (1, 3)))).alias("n_grams")),
        "char_ngram_total": lambda s, d: labelled(s, d).agg(F.sum(F.size(char_wb_ngrams(X.tokens(F.col("text"))))).cast("bigint").alias("n_grams")),
        "tfidf": tfidf,
        "word_char_vocabulary": feature_counts,
        "nb_priors": lambda s, d: naive_bayes(s, d)[0].priors.select("label", F.col("n").cast("bigint").alias("n"), F.round("log_prior", 9).alias("log_prior")),
        "feature_profile": feature_profile,
        "nb_predictions": nb_predictions,
        "nb_macro_metrics": lambda s, d: evaluate.macro_metrics(nb_predictions(s, d)),
        "svm_predictions": svm_predictions,
        "majority_predictions": lambda s, d: models.predict_majority(labelled(s, d), labelled(s, d)).groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n")),
        "grid_log": grid_log,
        "truncation": lambda s, d: models.truncation(comments(s, d).select((X.word_count(F.col("text")) + 2).alias("n_tokens")), 64),
        "encoded_lengths": lambda s, d: encode.encode(comments(s, d), encode.tokenizer_file(TOKENIZER), 64, 49406, 49407).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")),
        # evaluation
        "confusion_matrix": metrics_of(evaluate.confusion_matrix),
        "label_metrics": metrics_of(evaluate.label_metrics),
        "macro_metrics": metrics_of(evaluate.macro_metrics),
        "classification_report": metrics_of(evaluate.report),
        "slice_metrics": metrics_of(evaluate.slice_metrics),
        "errors_by_post": metrics_of(evaluate.errors_by),
        "misclassified": lambda s, d: evaluate.misclassified(rule_predictions(s, d)).select("id", "true_label", "predicted_label"),
        # annotation
        "vote_agreement": lambda s, d: annotate.pair_agreement(annotate.vote_pairs(votes(s, d))),
        "merged_votes": lambda s, d: annotate.merge_votes(votes(s, d)),
        "unanimity": lambda s, d: annotate.unanimity(annotate.merge_votes(votes(s, d))),
        "assignments": assignments,
        "assignment_checks": assignment_checks,
        "assignment_counts": lambda s, d: annotate.task_counts(assignments(s, d)),
        # splits and links
        "split_leaks": lambda s, d: split.leaks(split_rows(s, d)),
        "crossing_pairs": lambda s, d: split.crossing_pairs(clean_pairs(s, d), table(s, d, "split_groups")),
        "broken_components": lambda s, d: split.broken_groups(table(s, d, "split_groups")),
        "post_components": post_components,
        "grouped_split": lambda s, d: split.grouped_split(labelled(s, d)).select("id", "post_id", "label", "split"),
        "grouped_split_checks": grouped_split_checks,
        "jaccard_pairs": lambda s, d: duplicates.jaccard_candidates(one_per_id(comments(s, d)).withColumn("seq", F.col("id")))[0].select("id_a", "id_b", F.round("jaccard", 9).alias("jaccard")),
        "near_pairs": lambda s, d: duplicates.near_pairs(one_per_id(comments(s, d)).withColumn("seq", F.col("id"))),
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
