import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.labels import LABELS
from quern.operators import annotate, evaluate, features, graph, models, split
from quern.operators.prefix import running_sum
from quern.sources import tables


def labelled(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, text string")


TRAIN = [("1", "positive", "vui vui quá"), ("2", "positive", "rất vui"), ("3", "negative", "buồn quá"), ("4", "neutral", "hỏi chút 😊"), ("5", "negative", "chán")]


def test_bow_and_tfidf(spark):
    train = labelled(spark, TRAIN)
    bow = features.fit(train, features.Vectorizer("bow"))
    assert {(r.term, r.df, r.total) for r in bow.vocabulary.collect()} >= {("vui", 2, 3), ("😊", 1, 1)}
    new = labelled(spark, [("9", None, "vui vui lạ"), ("10", None, ""), ("11", None, None)])
    assert [(r.id, r.term, r.value) for r in bow.transform(new).collect()] == [("9", "vui", 2.0)]
    assert sorted(r.id for r in features.without_features(new, bow.transform(new)).collect()) == ["10", "11"]
    tfidf = features.fit(train, features.Vectorizer("tfidf"))
    idf = {r.term: r.idf for r in tfidf.vocabulary.collect()}
    assert idf["vui"] == pytest.approx(math.log(6 / 3) + 1)
    got = {r.term: r.value for r in tfidf.transform(train.where("id = '1'")).collect()}
    raw = {"vui": 2 * idf["vui"], "quá": idf["quá"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({k: v / norm for k, v in raw.items()})
    assert features.unseen_terms(tfidf, train).count() == 0
    with pytest.raises(ValueError):
        features.fit(train.limit(0), features.Vectorizer())


def test_vocabulary_limits(spark):
    train = labelled(spark, TRAIN)
    top = features.fit(train, features.Vectorizer("bow", max_features=2))
    assert {r.term for r in top.vocabulary.collect()} == {"vui", "quá"}
    assert {r.term for r in features.fit(train, features.Vectorizer("bow", min_df=2)).vocabulary.collect()} == {"vui", "quá"}
    assert "vui" not in {r.term for r in features.fit(train, features.Vectorizer("bow", max_df=0.3)).vocabulary.collect()}
    both = features.fit(train, features.Vectorizer("tfidf_word_char"))
    assert {r.term[:2] for r in both.vocabulary.collect()} == {"w:", "c:"}
    sums = both.transform(train).withColumn("part", F.substring("term", 1, 2)).groupBy("id", "part").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def nb_by_brute_force(train, texts, alpha):
    vocab = sorted({w for _, _, t in train for w in t.split()})
    out = {}
    for i, t in texts:
        scores = {}
        for y in sorted({y for _, y, _ in train}):
            docs = [x.split() for _, z, x in train if z == y]
            counts = {w: sum(d.count(w) for d in docs) for w in vocab}
            norm = sum(counts.values()) + alpha * len(vocab)
            scores[y] = math.log(len(docs) / len(train)) + sum(math.log((counts[w] + alpha) / norm) for w in t.split() if w in counts)
        out[i] = scores
    return out


def test_naive_bayes_against_brute_force(spark):
    train = labelled(spark, TRAIN)
    texts = [("a", "vui quá quá"), ("b", "lạ"), ("c", "hỏi buồn"), ("d", "")]
    fm = features.fit(train, features.Vectorizer("bow"))
    nb = models.fit_naive_bayes(train, fm.transform(train), fm.vocabulary, 0.5)
    new = labelled(spark, [(i, None, t) for i, t in texts])
    got = {r.id: r for r in models.softmax(nb.predict(new, fm.transform(new))).collect()}
    for i, scores in nb_by_brute_force(TRAIN, texts, 0.5).items():
        assert got[i].scores == pytest.approx(scores)
        assert got[i].predicted_label == max(sorted(scores), key=lambda y: scores[y])
        assert sum(got[i].probabilities.values()) == pytest.approx(1)


@pytest.mark.parametrize("weight", [None, "balanced"])
def test_svm_reaches_the_optimum(spark, weight):
    rng = random.Random(3)
    rows = [(str(i), y := rng.choice(LABELS), " ".join([{"positive": "vui", "neutral": "hỏi", "negative": "chán"}[y]] * (rng.random() < 0.8) + [rng.choice("abcdefg") for _ in range(4)])) for i in range(60)]
    train = labelled(spark, rows)
    fm = features.fit(train, features.Vectorizer("tfidf"))
    x = fm.transform(train)
    svm = models.fit_linear_svm(train, x, fm.vocabulary, c=1.0, class_weight=weight, tol=1e-5)
    terms = sorted(r.term for r in fm.vocabulary.collect())
    at = {t: k for k, t in enumerate(terms)}
    matrix = np.zeros((60, len(terms) + 1))
    matrix[:, -1] = 1
    for r in x.collect():
        matrix[int(r.id), at[r.term]] = r.value
    w = np.zeros((3, len(terms) + 1))
    for r in svm.weights.collect():
        w[LABELS.index(r.label), at[r.term] if r.term else -1] = r.weight
    for k, y in enumerate(LABELS):
        sign = np.array([1.0 if r[1] == y else -1.0 for r in rows])
        n = (sign > 0).sum()
        cost = np.where(sign > 0, 60 / (2 * n), 60 / (2 * (60 - n))) if weight else np.ones(60)
        slack = np.maximum(0, 1 - sign * (matrix @ w[k]))
        gradient = w[k] - 2 * ((cost * slack * sign) @ matrix)
        assert np.linalg.norm(gradient) < 1e-2
    pred = {r.id: r.predicted_label for r in svm.predict(train, x).collect()}
    assert sum(pred[i] == y for i, y, _ in rows) > 45
    with pytest.raises(models.NotConverged):
        models.fit_linear_svm(train, x, fm.vocabulary, max_iter=1)
    assert models.fit_with_retry(train, x, fm.vocabulary, max_iter=1, retry_max_iter=500, tol=1e-3).iterations > 1


def svm_case(spark):
    rng = random.Random(9)
    train = labelled(spark, [(str(i), rng.choice(LABELS), " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(7)))) for i in range(1200)]).repartition(3)
    fm = features.fit(train, features.Vectorizer("tfidf"), unique=True)
    return train, fm


def test_packed_features_are_the_long_ones(spark):
    train, fm = svm_case(spark)
    rows = lambda m: sorted(tuple(r) for r in m.vocabulary.select("part", "term", "df", "total", "idf").collect())
    for how in (features.Vectorizer("bow", (1, 2), min_df=2), features.Vectorizer("tfidf", max_features=9, sublinear_tf=True), features.Vectorizer("tfidf_word_char")):
        fm = features.fit(train, how, unique=True)
        assert rows(fm) == rows(features.fit(train, how))
        terms = [r.term for r in fm.vocabulary.orderBy("term").collect()]
        got = {(r.id, terms[j]): v for r in fm.pack(train).collect() for j, v in zip(r.j, r.v)}
        assert got == pytest.approx({(r.id, r.term): r.value for r in fm.transform(train).collect()})
        assert fm.pack(train).count() == 1200


def test_svm_of_packed_rows_takes_few_spark_jobs(spark, monkeypatch):
    train, fm = svm_case(spark)
    packed, context = fm.pack(train, ("id", "label")), spark.sparkContext
    context.setJobGroup("svm-jobs", "")
    try:
        svm = models.fit_linear_svm(train, packed, fm.vocabulary, tol=1e-6)
        assert len(context.statusTracker().getJobIdsForGroup("svm-jobs")) < 20  # however many sums the solver takes
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert svm.gradient_norm <= 1e-6
    weights = lambda m: {(r.label, r.term): r.weight for r in m.weights.collect()}
    monkeypatch.setattr(models, "_slots", lambda _: 0)
    monkeypatch.setattr(models, "MOST_SUMS", 1)
    by_jobs = models.fit_linear_svm(train, fm.transform(train), fm.vocabulary, tol=1e-6)
    assert weights(by_jobs) == pytest.approx(weights(svm), abs=1e-3)
    scores = {r.id: r for r in svm.predict(train, fm.transform(train)).collect()}
    for r in svm.predict_packed(packed, fm.vocabulary).collect():
        assert (r.predicted_label, r.scores) == (scores[r.id].predicted_label, pytest.approx(scores[r.id].scores))


def test_search_save_and_load(spark, tmp_path):
    rng = random.Random(5)
    make = lambda n, k: [(f"{k}{i}", y := rng.choice(LABELS), {"positive": "vui", "neutral": "hỏi", "negative": "chán"}[y] + " " + rng.choice("abc") + " quá") for i in range(n)]
    train, val = labelled(spark, make(30, "t")), labelled(spark, make(12, "v"))
    found = models.search(train, val, "bow", "nb")
    assert len(found.log) == 4 and found.best.score == max(r["validation_macro_f1"] for r in found.log) == 1.0
    assert found.best.settings["candidate"] == 0  # the first of equal ones
    path = str(tmp_path / "model")
    models.save_pipeline(found.best, path)
    again = models.load_pipeline(spark, path)
    new = labelled(spark, [("n1", None, "VUI lạ"), ("n2", None, "")])
    before, after = (sorted((r.id, r.predicted_label) for r in p.predict(new).collect()) for p in (found.best, again))
    assert before == after and before[0] == ("n1", "positive")
    with pytest.raises(Exception, match="exist"):
        models.save_pipeline(found.best, path)
    shown = models.predictions(new.drop("label"), models.softmax(again.predict(new)), "m").first()
    assert shown.true_label == "" and shown.model_name == "m" and shown.probability_positive is not None


def test_majority_and_truncation(spark):
    rows = labelled(spark, [("1", "b", "x"), ("2", "a", "x"), ("3", "b", "x"), ("4", "a", "x")])
    assert {r.predicted_label for r in models.predict_majority(rows, rows).collect()} == {"a"}
    lengths = spark.createDataFrame([(4,), (5,)], "n_tokens int")
    assert models.truncation(lengths, 4).first().asDict() == {"n_truncated": 1, "longest": 5, "truncated_share": 0.5}


# published confusion matrices (rows true, columns predicted) with accuracy and Macro-F1
MATRICES = [([[15, 27, 8], [11, 240, 20], [7, 37, 25]], 0.717949, 0.535355)]


def predicted(spark, matrix):
    rows = [(f"{i}-{j}-{n}", LABELS[i], LABELS[j]) for i in range(3) for j in range(3) for n in range(matrix[i][j])]
    return spark.createDataFrame(rows, "id string, true_label string, predicted_label string")


@pytest.mark.parametrize("matrix,accuracy,f1", MATRICES)
def test_published_metrics(spark, matrix, accuracy, f1):
    df = predicted(spark, matrix)
    m = evaluate.macro_metrics(df).first()
    assert round(m.accuracy, 6) == accuracy and round(m.macro_f1, 6) == f1
    got = {r.true_label: [r[x] for x in LABELS] for r in evaluate.confusion_matrix(df).collect()}
    assert [got[x] for x in LABELS] == matrix


def test_metrics_of_one_guess(spark):
    df = spark.createDataFrame([(x, "positive") for x in LABELS], "true_label string, predicted_label string")
    m = evaluate.macro_metrics(df).first()
    assert m.macro_f1 == pytest.approx(1 / 6)
    assert {r.label: r.f1 for r in evaluate.label_metrics(df).collect()}["negative"] == 0
    for bad in (df.limit(0), df.withColumn("true_label", F.lit("x"))):
        with pytest.raises(ValueError):
            evaluate.checked(bad)


def test_slices_and_errors(spark):
    rows = [("1", "p", "không vui", "negative", "neutral"), ("2", "p", "vui 😊", "positive", "positive"), ("3", None, None, "neutral", "neutral")]
    df = spark.createDataFrame(rows, "id string, post_id string, text string, true_label string, predicted_label string")
    got = {r.group: (r.support, r.errors) for r in evaluate.slice_metrics(df).collect()}
    assert got == {"all": (3, 1), "negation": (1, 1), "emoji": (1, 0), "short_1_5_words": (3, 1)}
    assert {r.post_id: (r.support, r.errors) for r in evaluate.errors_by(df).collect()} == {"p": (2, 1), None: (1, 0)}
    assert set(evaluate.evaluation_tables(df)) == {"metrics", "per_label", "confusion_matrix", "error_groups", "predictions", "errors", "errors_by_post"}


def test_comparison(spark):
    ddl = "model_name string, split_manifest_sha256 string, evaluation_data_sha256 string, split string, provenance string, n_samples int, accuracy double, macro_precision double, macro_recall double, macro_f1 double"
    row = lambda n, m, f: (n, m, "d", "test", "real", 3, 0.5, 0.5, 0.5, f)
    ok = spark.createDataFrame([row("a", "m", 0.3), row("b", "m", 0.4)], ddl)
    assert [r.model_name for r in evaluate.compare(ok).collect()] == ["b", "a"]
    for bad in ([row("a", "m", 0.3), row("b", "other", 0.4)], [row("a", "m", 0.3), row("a", "m", 0.4)]):
        with pytest.raises(ValueError):
            evaluate.compare(spark.createDataFrame(bad, ddl))


def test_components(spark):
    rng = random.Random(0)
    pairs = [(f"{rng.randrange(80):02d}", f"{rng.randrange(80):02d}") for _ in range(60)] + [("x", None), ("y", "y")] + [("hub", f"s{i}") for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_connected_posts(spark):
    ddl = "id string, post_id string"
    rows = spark.createDataFrame([("1", "d"), ("2", "c"), ("3", "b"), ("4", "a"), ("5", "z")], ddl)
    pairs = spark.createDataFrame([("1", "2"), ("3", "4")], "id_a string, id_b string")
    history = spark.createDataFrame([("2", "b")], "canonical_id string, post_id string")
    got = {r.post_id: r.split_component for r in graph.connected_posts(rows, rows, pairs, history).collect()}
    import hashlib

    assert got["a"] == got["b"] == got["c"] == got["d"] == "split_component_" + hashlib.sha256(b"a").hexdigest()[:16] != got["z"]
    with pytest.raises(ValueError):
        graph.connected_posts(rows, rows, spark.createDataFrame([("1", "9")], "id_a string, id_b string"))
    with pytest.raises(ValueError):
        graph.connected_posts(spark.createDataFrame([("1", " ")], ddl), rows, pairs)


def grouped(spark, posts=20):
    return spark.createDataFrame([(f"{p}-{x}", f"{p:02d}", f"t {p} {x}", x) for p in range(posts) for x in LABELS], "id string, post_id string, text string, label string")


def test_grouped_split(spark):
    df = grouped(spark)
    a, b = (split.grouped_split(df).toPandas().sort_values("id").split.tolist() for _ in range(2))
    assert a == b and a != split.grouped_split(df, seed=7).toPandas().sort_values("id").split.tolist()
    # groups of three rows: a split is off by half a group at most
    assert abs(a.count("train") - 42) <= 2 and abs(a.count("validation") - 9) <= 3
    out = split.check_disjoint(split.grouped_split(df))
    assert split.broken_groups(out, "post_id").count() == 0 and out.columns == ["post_id", "id", "text", "label", "split"]
    for bad in (grouped(spark, 2), df.limit(0), df.withColumn("post_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            split.grouped_split(bad)
    for ratios in ((0.5, 0.5, 0.5), (0.5, 0.5), (1.0, 0.5, -0.5), (float("nan"), 0.5, 0.5)):
        with pytest.raises(ValueError):
            split.grouped_split(df, ratios=ratios)
    # a label in three groups only: later passes find an arrangement that has it in all splits
    rare = grouped(spark, 60).where("label <> 'neutral' OR post_id < '03'")
    assert split.missing_labels(split.grouped_split(rare, seed=1)).count() == 0
    with pytest.raises(ValueError):
        split.grouped_split(rare.where("label <> 'neutral' OR post_id < '02'"))


def test_a_group_of_a_third_of_the_rows(spark):
    rows = [(f"{i}", "hot" if i % 3 == 0 else f"p{i % 50}", f"t{i}", LABELS[i % 3 if i % 2 else (i + 1) % 3]) for i in range(900)]
    out = split.grouped_split(spark.createDataFrame(rows, "id string, post_id string, text string, label string"))
    shares = {r.split: r["count"] / 900 for r in out.groupBy("split").count().collect()}
    assert all(abs(shares[n] - x) < 0.2 for n, x in zip(split.SPLIT_NAMES, split.RATIOS)) and split.broken_groups(out, "post_id").count() == 0


def test_leaks(spark):
    df = spark.createDataFrame([("1", "p", "Vui", "positive", "train"), ("2", "p", "x", "neutral", "test"), ("3", "q", "vui ", "negative", "test"), ("3", "r", "y", "negative", "validation")], "id string, post_id string, text string, label string, split string")
    assert sorted((r.kind, r.n_splits) for r in split.leaks(df).collect()) == [("id", 2), ("post_id", 2), ("text", 2)]
    with pytest.raises(ValueError):
        split.check_disjoint(df)
    pairs = spark.createDataFrame([("1", "2"), ("1", "9"), ("2", "3")], "id_a string, id_b string")
    assert sorted((r.id_a, r.id_b) for r in split.crossing_pairs(pairs, df).collect()) == [("1", "2"), ("2", "3")]


def test_split_dataset_keeps_near_duplicates_together(spark):
    df = grouped(spark, 24)
    pairs = spark.createDataFrame([("0-positive", "1-negative"), ("1-neutral", "2-neutral")], "id_a string, id_b string")
    out = split.split_dataset(df, df, pairs, attempts=100)
    assert out.where("post_id IN ('00', '01', '02')").select("split").distinct().count() == 1


def votes(spark, rows):
    return spark.createDataFrame(rows, "id string, person int, role string, label string, annotation_status string, reviewer string, post_id string, text string")


def test_assignments(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(101)], "id string")
    cross, common = df.limit(20), annotate.sample_rows(df, 10, 1)
    a = annotate.assign(df, 4, cross, common, seed=3).toPandas()
    primary = a[a.role == "primary"]
    assert sorted(primary.id) == [f"{i:03d}" for i in range(101)] and primary.person.value_counts().max() - primary.person.value_counts().min() <= 1
    assert (a.groupby("id").person.nunique() == a.groupby("id").size()).all()
    assert (a.groupby("id").size()[[r.id for r in common.collect()]] == 4).all()
    assert set(a[a.role == "cross_check"].id) == {r.id for r in cross.collect()} - {r.id for r in common.collect()}
    again = annotate.assign(df, 4, cross, common, seed=3).toPandas()
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, again.values))


def test_merge_without_majority_vote(spark):
    ok = "human_confirmed"
    v = votes(spark, [
        ("1", 1, "primary", "positive", ok, "a", "p", "x"), ("1", 2, "common", "positive", ok, "b", "p", "x"), ("1", 3, "common", "negative", ok, "c", "p", "x"),
        ("2", 1, "primary", "neutral", ok, "a", "p", "y"), ("2", 2, "cross_check", "neutral", ok, "b", "p", "y"),
        ("3", 1, "primary", "neutral", ok, " ", "p", "z"), ("4", 1, "primary", "neutral", ok, "a", "p", "w"),
    ])
    tasks = v.select("id", "person", "role").unionByName(spark.createDataFrame([("4", 2, "cross_check")], "id string, person int, role string"))
    m = annotate.merge_votes(v, tasks)
    got = {r.id: (r.label, r.issue_reason) for r in m.collect()}
    assert got == {"1": (None, "disagreement"), "2": ("neutral", None), "3": (None, "missing_invalid_or_unconfirmed"), "4": (None, "missing_invalid_or_unconfirmed")}
    u = annotate.unanimity(m).first()
    assert (u.n_complete, u.unanimous_share) == (2, 0.5)
    base = spark.createDataFrame([("1", "p", "x"), ("2", "p", "y"), ("3", "p", "z"), ("4", "p", "changed")], "id string, post_id string, text string")
    issues = sorted((r.id, r.person, r.issue) for r in annotate.vote_issues(tasks, v, base).collect())
    assert issues == [("3", 1, "confirmed_without_reviewer"), ("4", 1, "changed_field"), ("4", 2, "missing_row")]
    res = "id string, final_label string, annotation_status string, reviewer string, reason string"
    done = annotate.adjudicate(m, spark.createDataFrame([("1", "positive", ok, "lead", "r")], res))
    assert {r.id: r.label_source for r in done.collect()}["1"] == "human_adjudication"
    for bad in [("2", "positive", ok, "lead", "r")], [("1", "positive", ok, "lead", " ")], [("1", "x", ok, "lead", "r")]:
        with pytest.raises(ValueError):
            annotate.adjudicate(m, spark.createDataFrame(bad, res))
    assert {r.id: (r.label, r.annotation_status) for r in annotate.reviewed(base, m).collect()}["2"] == ("neutral", ok)


def test_agreement(spark):
    ok = "human_confirmed"
    rows = []
    labels = [("positive", "positive"), ("positive", "negative"), ("neutral", "neutral"), ("negative", "negative")]
    for i, (a, b) in enumerate(labels):
        rows += [(str(i), 1, "primary", a, ok, "a", "p", "x"), (str(i), 2, "cross_check", b, ok, "b", "p", "x")]
    k = annotate.pair_agreement(annotate.vote_pairs(votes(spark, rows))).first()
    assert k.n_pairs == 4 and k.agreement == 0.75 and k.kappa == pytest.approx((0.75 - 0.3125) / (1 - 0.3125))
    none = annotate.pair_agreement(annotate.vote_pairs(votes(spark, []))).first()
    assert none.n_pairs == 0 and none.agreement is None and none.kappa is None


def test_decisions(spark):
    base = spark.createDataFrame([("1", "positive", "human_confirmed", "r", "human"), ("2", "", "", "", ""), ("3", "", "", "", ""), ("4", "", "", "", "")], "id string, label string, annotation_status string, reviewer string, label_source string")
    d = spark.createDataFrame([("1", "negative", "low", "x", "keep"), ("2", "neutral", "low", "x", None), ("3", "", "high", "x", "exclude")], "id string, suggested_label string, review_priority string, reason string, action string")
    got = {r.id: (r.label, r.label_source, r.annotation_status, r.review_priority) for r in annotate.label_decisions(base, d).collect()}
    assert got == {"1": ("positive", "human", "human_confirmed", "low"), "2": ("neutral", "ai", "ai_labeled", "low"), "4": ("", "ai", "unresolved", "high")}
    bad = d.unionByName(spark.createDataFrame([("2", "x", "urgent", " ", "drop"), ("9", "", "low", "x", "keep")], d.schema))
    assert sorted((r.id, r.problem) for r in annotate.decision_problems(bad, base).collect()) == [("2", "action"), ("2", "label"), ("2", "priority"), ("2", "reason"), ("2", "repeated"), ("9", "unclear_not_high"), ("9", "unknown_id")]


def test_stratified_sample(spark):
    df = spark.createDataFrame([(f"{i}", "a" if i % 10 else "b") for i in range(500)], "id string, label string")
    got = annotate.stratified_sample(df, "label", 30).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 30, "b": 30}


def test_running_sum(spark):
    rng = random.Random(0)
    rows = [(rng.choice("aab"), i, rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {r.o: r.s for r in running_sum(df, ["g"], ["o"], F.floor(F.col("o") / 20), F.col("v"), "s").collect()}
    sums = {}
    for g, o, v in rows:
        assert got[o] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)


def test_csv_round_trip(spark, tmp_path):
    rows = [("001", 'có "nháy", phẩy\nvà dòng', "NA"), ("002", "", "null"), ("003", " x ", "=1+1")]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    tables.write_csv(df, str(tmp_path / "t"), single=True)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t")).collect())) == rows
    with pytest.raises(Exception, match="exist"):
        tables.write_csv(df, str(tmp_path / "t"))


@pytest.mark.parametrize("text,message", [("id,id\n1,2\n", "header"), ("id,\n1,2\n", "header"), ("", "header"), ("a,b\n1,2\n", "missing")])
def test_bad_headers(spark, tmp_path, text, message):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(ValueError, match=message):
        tables.read_csv(spark, str(tmp_path / "x.csv"), ("id",))


def test_ragged_rows_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿id,text\n1,a\n2,b,c\n", encoding="utf-8")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "x.csv")).collect()


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"data": [{"id": "01", "text": "x", "other": 1}, {"id": 2, "text": "y"}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"id": "03", "text": "z"}]')
    (tmp_path / "c.jsonl").write_text('{"id": "04", "text": "u"}\n\n{"id": "05"}\nbroken\n')
    (tmp_path / "d.csv").write_text("id,text\n06,v\n")
    read = lambda n: sorted(((r.id, r.text, r._invalid) for r in tables.read_export(spark, str(tmp_path / n), ["id", "text"]).collect()), key=str)
    assert read("a.json") == [("01", "x", False), ("2", "y", True)]
    assert read("b.json") == [("03", "z", False)] and read("d.csv") == [("06", "v", False)]
    assert read("c.jsonl") == sorted([("04", "u", False), ("05", None, False), (None, None, True)], key=str)
    with pytest.raises(ValueError):
        tables.read_export(spark, "x.xlsx", ["id"])
    with pytest.raises(ValueError):
        tables.map_columns(tables.literal(spark, "x"), {"id": "id"})


def test_captures_and_decisions(spark, tmp_path):
    (tmp_path / "s1.json").write_text('[{"id": "1", "post_id": "p", "text": "a"}]')
    (tmp_path / "s2.json").write_text('{"comments": [{"id": "2", "post_id": "p", "text": "b"}]}')
    sources = spark.createDataFrame([("s1.json", "src")], "file string, source_id string")
    got = sorted((r.id, r.capture_file, r.source_id) for r in tables.read_captures(spark, str(tmp_path), sources=sources).collect())
    assert got == [("1", "s1.json", "src"), ("2", "s2.json", "")]
    d = tmp_path / "b"
    d.mkdir()
    (d / "batch_0001.json").write_text('{"base_sha256": "h", "decisions": [{"id": "1", "seq": 1, "suggested_label": "neutral", "review_priority": "low", "reason": "r"}]}')
    assert [r.seq for r in tables.read_decisions(spark, str(d), "h").collect()] == [1]
    with pytest.raises(ValueError, match="base"):
        tables.read_decisions(spark, str(d), "other")
    (d / "batch_0002.json").write_text('{"base_sha256": "h", "decisions": [{"id": "1", "seq": 1}]}')
    with pytest.raises(ValueError, match="more than one"):
        tables.read_decisions(spark, str(d), "h")


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int").repartition(6)
    assert sorted((r.k, r.seq) for r in tables.with_row_number(df, ["k"]).collect()) == [(i, i + 1) for i in range(50)]


def test_hashes_and_upserts(spark):
    a = spark.createDataFrame([("1", None), ("2", "x"), ("2", "x")], "id string, t string")
    assert tables.dataset_hash(a) == tables.dataset_hash(a.repartition(3).orderBy(F.desc("id")))
    assert tables.dataset_hash(a) != tables.dataset_hash(a.distinct()) != tables.dataset_hash(a.na.fill("").distinct())
    old, new = spark.createDataFrame([("1", "old")], "id string, t string"), spark.createDataFrame([("1", "new"), ("3", "n")], "id string, t string")
    assert {r.id: r.t for r in tables.upsert(old, new, ["id"], ["t"]).collect()} == {"1": "old", "3": "n"}
    assert {r.id: r.t for r in tables.upsert(old, new, ["id"], ["t"], replace=True).collect()} == {"1": "new", "3": "n"}
    many = spark.createDataFrame([("1", "b", 2), ("1", "a", 3), ("1", "c", 1)], "id string, t string, n int")
    empty = many.limit(0)
    assert [r.t for r in tables.upsert(empty, many, ["id"], ["n"], replace=True).collect()] == ["a"]  # the last of them
    assert [r.t for r in tables.upsert(empty, many, ["id"], ["n"]).collect()] == ["c"]  # the first


def test_saved_splits(spark, tmp_path):
    df = split.grouped_split(grouped(spark))
    path = str(tmp_path / "s")
    tables.save_splits(df, path, "h", {"seed": 42})
    rows, manifest = tables.load_splits(spark, path)
    assert rows.count() == 60 and manifest["splits"]["train"]["posts"] in (13, 14)
    with pytest.raises(ValueError):
        tables.save_splits(df, path, "h", {})
    rows.where("split = 'test'").limit(1).drop("split").write.mode("append").parquet(f"{path}/rows/split=test")
    with pytest.raises(ValueError, match="changed"):
        tables.load_splits(spark, path)
