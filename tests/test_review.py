import pytest
from pyspark.sql import functions as F

from quern import workspace
from quern.labels import LABELS
from quern.operators import annotate, evaluate, features, models, quality, review, split
from quern.sources import tables
from quern.streaming import ingest

DECISION = "seq bigint, suggested_label string, review_priority string, reason string, action string"


def base(spark):
    rows = [(1, "a", "p", "vui", "flag_b", "", "", ""), (2, "b", "p", "...", "", "", "", ""), (3, "c", "q", "hỏi", "", "neutral", "human_confirmed", "r"), (4, "d", None, None, None, "positive", "human_confirmed", " ")]
    return spark.createDataFrame(rows, "seq bigint, id string, post_id string, text string, audit_flags string, label string, annotation_status string, reviewer string")


def decided(spark, rows):
    return spark.createDataFrame(rows, DECISION)


def test_record_view_and_export(spark, tmp_path):
    b, folder = base(spark), str(tmp_path / "batches")
    first = review.record(b, decided(spark, [(1, "positive", "low", "vui", "keep")]), folder, "h", "2026-01-01T00:00:00+00:00")
    second = review.record(b, decided(spark, [(2, "", "high", "dots", "exclude")]), folder, "h", "2026-01-02T00:00:00+00:00")
    assert first.endswith("batch_0001.json") and second.endswith("batch_0002.json")
    d = tables.read_decisions(spark, folder, "h")
    assert [r.seq for r in review.view(b, d, 1, 3).collect()] == [3]
    bad = [[(1, "positive", "low", "again", "keep")], [(9, "positive", "low", "x", "keep")], [(3, "x", "low", "x", "keep")], [(3, "", "low", "x", "keep")], [(3, "neutral", "low", " ", "keep")], [], [(3, "neutral", "low", "x", "keep")] * 2]
    for rows in bad:
        with pytest.raises(ValueError):
            review.record(b, decided(spark, rows), folder, "h", "now")
    with pytest.raises(ValueError, match="base"):
        review.record(b, decided(spark, [(3, "neutral", "low", "x", "keep")]), folder, "other", "now")
    s = {r.id: r for r in review.suggestions(b, d).collect()}
    assert set(s) == {"a", "c", "d"} and tuple(s["a"].asDict()) == review.SUGGESTION_FIELDS
    assert (s["a"].suggested_label, s["a"].label, s["a"].ai_processed, s["a"].audit_flags) == ("positive", "", "yes", "flag_b")  # a suggestion is no label
    assert (s["c"].label, s["c"].annotation_status, s["c"].review_priority, s["c"].ai_processed) == ("neutral", "human_confirmed", "high", "no")
    assert s["d"].label == "" and s["d"].annotation_status == "pending_review"  # no reviewer
    t = review.suggestions(b, d)
    assert {r.id for r in review.required(t).collect()} == {"c", "d"} == {r.id for r in review.unprocessed(t).collect()}
    assert {r.id for r in review.sample(t).collect()} == {"a"} and {r.id for r in review.to_review(t).collect()} == {"a", "c", "d"}
    assert [tuple(r) for r in review.excluded(b, d).collect()] == [("b", "dots", "language_review")]
    p = {r.metric: r.value for r in review.progress(b, d).collect()}
    assert (p["valid_rows"], p["remaining_rows"], p["suggested_positive"], p["human_neutral"]) == (3, 2, 1, 1)
    assert review.suggestions(b.limit(0), d).count() == 0


def votes(spark, labels):
    rows = [(str(i), role, x, "human_confirmed", who) for i, pair in enumerate(labels) for x, role, who in zip(pair, ("primary", "cross_check"), "ab")]
    return spark.createDataFrame(rows, "id string, role string, label string, annotation_status string, reviewer string")


def test_release_gate(spark):
    none = spark.createDataFrame([], "id string, issue string")
    same = votes(spark, [("positive", "positive"), ("neutral", "neutral")])
    report, labels = review.release(annotate.merge_votes(same), same, none, 2)
    assert report["status"] == "confirmed" and {r.id: r.label for r in labels.collect()} == {"0": "positive", "1": "neutral"}
    # an issue, a pair that is missing, a disagreement
    assert review.release(annotate.merge_votes(same), same, none.union(spark.createDataFrame([("0", "x")], none.schema)), 2)[1] is None
    assert review.release(annotate.merge_votes(same), same, none, 3)[0]["quality_review_required"]
    other = votes(spark, [("positive", "positive"), ("neutral", "negative")])
    report, labels = review.release(annotate.merge_votes(other), other, none, 2)
    assert labels is None and report["cross_agreement"] == 0.5 and report["unresolved_samples"] == 1
    # settled by hand, the agreement still is too low
    m = annotate.adjudicate(annotate.merge_votes(other), spark.createDataFrame([("1", "neutral", "human_confirmed", "lead", "r")], "id string, final_label string, annotation_status string, reviewer string, reason string"))
    assert review.release(m, other, none, 2)[1] is None and review.release(m, other, none, 2, 0.5)[1] is not None
    with pytest.raises(ValueError):
        review.release(m, other, none, 2, 1.5)


def test_alignment_and_excerpts(spark):
    a = spark.createDataFrame([(1, "x", "u"), (2, "y", None), (3, "z", "w")], "seq int, id string, t string")
    b = spark.createDataFrame([(1, "x", "u"), (2, "y", "v"), (4, "q", "w")], "seq int, id string, t string")
    assert sorted((r.seq, r.problem) for r in review.aligned(a, b, ["id", "t"]).collect()) == [(2, "t"), (3, "only_first"), (4, "only_second")]
    rows = spark.createDataFrame([("1", "rất   vui\nhôm nay"), ("2", None)], "id string, text string")
    e = spark.createDataFrame([("1", "vui hôm"), ("1", "buồn"), ("2", "x"), ("9", "x")], "id string, excerpt string")
    assert sorted(map(tuple, review.false_excerpts(e, rows).select("id", "excerpt").collect())) == [("1", "buồn"), ("2", "x"), ("9", "x")]


def test_collect_isolates_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cid,post_id,text\n001,010,một\n002,011,hai\n002,011,ba\n")
    (tmp_path / "b.jsonl").write_text('{"id": "003", "post_id": "012", "text": "MỘT"}\n{"id": "004", "post_id": "012", "text": "bốn"}\n')
    (tmp_path / "c.csv").write_text("body\nx\n")
    store = str(tmp_path / "store")
    source = lambda n, f, **x: {"source_id": n, "source_url": "https://x.example", "permission_note": "ok", "exports": [{"path": str(tmp_path / f)} | x]}
    sources = [source("a", "a.csv") | {"columns": {"id": "cid"}}, source("c", "c.csv"), source("pinned", "b.jsonl", sha256="0" * 64), source("b", "b.jsonl"), {"source_id": "d"}]
    report = ingest.collect_sources(spark, sources, store, target=3)
    assert report["sources"]["a"] == {"comments": 2, "duplicates": 0, "rejected": 1} and report["sources"]["b"] == {"comments": 1, "duplicates": 1, "rejected": 0}
    assert report["failed"] == 3 and "pinned" in report["sources"]["pinned"]["error"] and report["valid_unique_ids"] == 3 and report["target_reached"]
    with pytest.raises(ValueError, match="c: "):
        ingest.raise_failed(report)
    out = str(tmp_path / "snapshot")
    for _ in range(2):  # the second replaces the first
        assert ingest.snapshot(spark, store, out) == 3
    assert [r.id for r in tables.read_csv(spark, out).orderBy("id").collect()] == ["001", "002", "004"]
    again = ingest.collect_sources(spark, sources[:1], store)
    assert again["sources"]["a"] == {"comments": 2, "duplicates": 0, "rejected": 1} and again["valid_unique_ids"] == 3  # a retry repeats nothing


def test_saved_splits_are_checked(spark, tmp_path):
    rows = [(f"{p}-{x}", f"{p:02d}", f"t {p} {x}", x, "s" if p < 3 else "ai", "human_confirmed" if p < 3 else "ai_labeled", "r") for p in range(20) for x in LABELS]
    df = split.grouped_split(spark.createDataFrame(rows, "id string, post_id string, text string, label string, label_source string, annotation_status string, reviewer string"))
    tables.save_splits(df, str(tmp_path / "ok"), "h", {})
    loaded, manifest = tables.load_splits(spark, str(tmp_path / "ok"), df)
    assert loaded.count() == 60 and len(manifest["manifest_sha256"]) == 64
    with pytest.raises(ValueError, match="ids"):
        tables.load_splits(spark, str(tmp_path / "ok"), df.limit(10))
    bad = {"leak": df.withColumn("post_id", F.lit("one")), "label": df.where("split <> 'test' OR label <> 'neutral'"), "origin": df.withColumn("label_source", F.lit("ai"))}
    for name, changed in bad.items():
        tables.save_splits(changed, str(tmp_path / name), "h", {})
        with pytest.raises(ValueError):
            tables.load_splits(spark, str(tmp_path / name))


def test_model_guards(spark, tmp_path):
    rows = [(f"{s}{i}", f"{s}{i}", {"positive": "vui", "neutral": "hỏi", "negative": "chán"}[x] + f" {i}", x, s) for s in ("train", "validation", "test") for i, x in enumerate(LABELS * 3)]
    df = spark.createDataFrame(rows, "id string, post_id string, text string, label string, split string")
    tables.save_splits(df, str(tmp_path / "s"), "h", {})
    loaded, manifest = spark.read.parquet(str(tmp_path / "s/rows")), tables.read_json(spark, str(tmp_path / "s/manifest.json"))
    found = models.search(loaded.where("split = 'train'"), loaded.where("split = 'validation'"), "bow", "nb", ngrams=((1, 1),), params=(1.0,), stop_words=["lắm"], about={"split_manifest_sha256": manifest["manifest_sha256"]})
    about = models.save_pipeline(found.best, str(tmp_path / "m"))
    out = evaluate.evaluate_model(models.load_pipeline(spark, str(tmp_path / "m")), loaded, manifest)
    m = out["metrics"].first()
    assert m.model_name == "bow+nb" and m.n_samples == 9 and m.macro_f1 == 1.0
    assert {r.label: r.support for r in out["report"].collect()} == {"positive": 3, "neutral": 3, "negative": 3, "macro_avg": 9}
    assert evaluate.compare(out["metrics"]).count() == 1
    with pytest.raises(ValueError, match="other splits"):
        evaluate.evaluate_model(found.best, loaded, manifest | {"manifest_sha256": "x"})
    lock = str(tmp_path / "lock.json")
    models.selection_lock(spark, lock, {"bow+nb": about}, manifest["manifest_sha256"])
    models.check_lock(spark, lock, "bow+nb", about, manifest["manifest_sha256"])
    for args in (("bow+nb", about | {"tables_sha256": {}}, manifest["manifest_sha256"]), ("other", about, manifest["manifest_sha256"]), ("bow+nb", about, "x")):
        with pytest.raises(ValueError, match="selected"):
            models.check_lock(spark, lock, *args)
    spark.createDataFrame([("positive", 1, 0.0)], found.best.model.priors.schema).write.mode("append").parquet(str(tmp_path / "m/priors"))
    with pytest.raises(ValueError, match="changed"):
        models.load_pipeline(spark, str(tmp_path / "m"))


def test_feature_audit(spark):
    train = spark.createDataFrame([("1", "vui vui"), ("2", "chán"), ("3", "")], "id string, text string")
    fm = features.fit(train, features.Vectorizer("tfidf"))
    assert features.wrong_weights(fm, train).count() == 0
    assert {r.term for r in features.wrong_weights(fm, train.where("id <> '2'")).collect()} == {"vui", "chán"}  # other rows, other weights
    assert features.matrix_profile(train, fm.transform(train)).first().asDict() == {"n_rows": 3, "n_terms": 2, "stored": 2, "zero_rows": 1}


def test_near_flag_and_report(spark):
    rows = spark.createDataFrame([(1, "a", "p", "vui"), (2, "b", "p", "..."), (3, "c", "p", "vui.")], "seq long, id string, post_id string, text string")
    out = quality.flag_near(quality.audit(rows), spark.createDataFrame([("a", "c"), ("x", None)], "id_a string, id_b string"))
    assert {r.id for r in out.where(F.array_contains("audit_flags", "near_duplicate_candidate")).collect()} == {"a", "c"}
    got = {(r.kind, r.value): r.n for r in quality.audit_report(out).collect()}
    assert got["rows", "all"] == 3 and got["rows", "excluded"] == 1 and got["flag", "near_duplicate_candidate"] == 2 and got["reason", "punctuation_only_no_sentiment_evidence"] == 1


def test_audit_of_a_hot_id(spark):
    rows = [(n, "hot" if n % 3 else f"i{n}", "p", f"t{n // 30}") for n in range(300)]
    out = {r.seq: r.reasons for r in quality.audit(spark.createDataFrame(rows, "seq long, id string, post_id string, text string").repartition(5)).collect()}
    last = None
    for n, i, _, t in rows:
        want = [] if i != "hot" else ["conflicting_id"] if last in (None,) or t != last else ["duplicate_id"]
        assert out[n] == want, n
        last = t if i == "hot" else last


def test_spreadsheet_file(spark, tmp_path):
    df = spark.createDataFrame([("001", 'a "b", c\nd', "x"), ("002", None, "y")], "id string, text string, more string")
    path = str(tmp_path / "t.csv")
    for _ in range(2):  # the second replaces the first
        tables.write_table(df.orderBy("id"), path, ["text", "id"])
    assert (tmp_path / "t.csv").read_bytes() == '\ufefftext,id\n"a ""b"", c\nd",001\n,002\n'.encode()
    assert [r.id for r in tables.read_csv(spark, path).collect()] == ["001", "002"]


def test_archived_names():
    assert tables.archived_name("/x/labels.csv", "ab" * 32) == "/x/labels_" + "ab" * 6 + ".csv"
    assert tables.archived_name("labels", "ab" * 32) == "labels_" + "ab" * 6


def test_intermediate_tables_are_cleared(spark):
    w = workspace.Workspace(spark, "cleared")
    w.save(spark.range(3))
    assert tables.exists(spark, w.path)
    assert workspace.clear() and not tables.exists(spark, w.path)
