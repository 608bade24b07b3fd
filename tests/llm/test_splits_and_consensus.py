import math
import random

from pyspark.sql import functions as F

from quern.llm import consensus, splits


def labelled(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], "id string, post_id string, label string, split string, component int")


def test_hash_to_min(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"), (None, "z"), ("d", "c"), ("y", "w"), ("a", "b")]
    got = {r.node: r.component for r in splits.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "w", "y": "w", "w": "w", "q": "q"}
    assert splits.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_records_with_several_entities(spark):
    df = spark.createDataFrame([("1", "p", "u"), ("2", "p", "v"), ("3", "q", "v"), ("4", "r", None), ("5", None, None), ("6", None, "w"), ("6", "r", None)], "id string, post string, author string")
    got = {r.id: r.component for r in splits.components(df, "id", [F.col("post"), F.col("author")]).collect()}
    assert got["1"] == got["2"] == got["3"] and got["4"] == got["6"] != got["1"] and got["5"] == "id:5"


def test_posts_stay_whole_and_shares_are_met(spark):
    rng = random.Random(0)
    data = [(str(i), "Hot " if i % 3 == 0 else f"p{rng.randrange(800)}", rng.choice(["positive", "neutral", "negative"])) for i in range(6000)]
    data += [("x", None, "neutral"), ("y", " ", "neutral"), (None, "p1", "neutral"), ("z", "hot", None), ("0", "hot", "neutral")]
    out = splits.grouped_splits(labelled(spark, data)).toPandas()
    assert len(out) == out.id.nunique() == 6002
    posts = dict((i, (p or "").strip().lower()) for i, p, _ in data)
    out["post"] = out.id.map(posts)
    assert out[out.post != ""].groupby("post").split.nunique().max() == 1
    shares = out.split.value_counts(normalize=True)
    for name, share in splits.SPLITS:
        assert abs(shares[name] - share) < 0.02
    assert out.groupby("split").label.nunique().min() == 3
    again = splits.grouped_splits(labelled(spark, data)).toPandas()
    assert dict(zip(out.id, out.split)) == dict(zip(again.id, again.split))


def test_one_group_labels_that_are_absent_and_no_rows(spark):
    one = splits.grouped_splits(labelled(spark, [("1", "p", "neutral"), ("2", "p", "positive"), ("3", "p", "negative")])).collect()
    assert len(one) == 3 and len({r.split for r in one}) == 1
    # two of the three labels, the third in two posts only: neither is asked for
    data = [(str(i), f"p{i}", ("positive", "neutral")[i % 2]) for i in range(300)] + [("x", "px", "negative"), ("y", "py", "negative")]
    out = splits.grouped_splits(labelled(spark, data)).toPandas()
    assert len(out) == 302 and out[out.label != "negative"].groupby("split").label.nunique().min() == 2
    assert splits.grouped_splits(labelled(spark, [])).count() == 0


def test_a_component_of_half_the_rows_leaves_the_others_their_share(spark):
    data = [(str(i), "hot" if i % 2 else f"p{i % 700}", ("positive", "neutral", "negative")[i % 3]) for i in range(6000)]
    out = splits.grouped_splits(labelled(spark, data)).toPandas()
    shares = out.split.value_counts(normalize=True)
    assert all(abs(shares[name] - share) < 0.02 for name, share in splits.SPLITS)


def test_two_keys_link_posts_by_content(spark):
    long = "một hai ba bốn năm sáu bảy tám"
    rows = [("1", "a", long, "neutral"), ("2", "b", long.upper() + "!", "positive"), ("3", "b", "khác", "neutral"), ("4", "c", "khác", "negative"), ("5", None, long, "neutral"), ("6", None, None, "neutral")]
    df = spark.createDataFrame(rows, "id string, post_id string, text string, label string")
    out = {r.id: r.component for r in splits.grouped_splits(df, keys=[splits.post_key(F.col("post_id")), splits.content_key(F.col("text"))]).collect()}
    assert out["1"] == out["2"] == out["3"] == out["5"] and out["4"] != out["1"] and out["6"] == "id:6"


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(str(i), f"p{rng.randrange(60)}" if rng.random() < 0.8 else None, f"a{rng.randrange(90)}" if rng.random() < 0.7 else None) for i in range(160)]
    got = {r.id: r.component for r in splits.components(spark.createDataFrame(rows, "id string, p string, a string"), "id", [F.col("p"), F.col("a")]).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, p, a in rows:
        for e in (p, a):
            if e:
                parent[find(f"id{i}")] = find(e)
    classes = {}
    for i, _, _ in rows:
        classes.setdefault(find(f"id{i}"), set()).add(got[i])
    assert all(len(c) == 1 for c in classes.values()) and len(set(got.values())) == len(classes)


def test_broken_posts(spark):
    rows = [("1", " 12", "a", "train"), ("2", "12", "b", "test"), ("3", "012", "c", "test"), ("4", None, "d", "train"), ("5", None, "d", "test"), ("6", "P9", "e", "train"), ("7", "p9 ", "f", "validation"), ("8", "x", "g", "train"), ("9", "x", "g", None)]
    df = spark.createDataFrame(rows, "id string, post_id string, split_component string, split string")
    assert sorted(r.post_id for r in splits.broken_posts(df).collect()) == ["12", "p9"]
    assert splits.broken_posts(df.limit(0)).count() == 0


ANN = "id string, reviewer string, label string, annotation_status string, submitted_at timestamp, role string, weight string"


def votes(spark, data):
    from datetime import datetime

    return spark.createDataFrame([(i, r, x, s, None if t is None else datetime(2026, 1, 1, 0, 0, t), "primary", "w") for i, r, x, s, t in data], ANN)


def test_chi_squared_quantiles():
    # tabulated values
    assert consensus.chi2_quantile(0.025, [1, 2, 10, 100]).round(4).tolist() == [0.001, 0.0506, 3.247, 74.2219]
    assert consensus.chi2_quantile(0.05, [5, 30]).round(3).tolist() == [1.145, 18.493]
    # the normal limit
    assert abs(consensus.chi2_quantile(0.025, [10**8])[0] - (10**8 - 1.959964 * math.sqrt(2 * 10**8))) < 50


def test_outvoted(spark):
    ok = "human_confirmed"
    data = [
        ("1", "A ", "Positive", ok, 1), ("1", "b", "positive", ok, 1), ("1", "c", "negative", ok, 1),
        ("2", "a", "positive", ok, 1), ("2", "b", "negative", ok, 1),  # two reviewers
        ("3", "a", "positive", ok, 1), ("3", "b", "negative", ok, 1), ("3", "c", "neutral", ok, 1),  # no majority
        ("4", "a", "negative", ok, 1), ("4", "a", "positive", ok, 2), ("4", "b", "positive", ok, 1), ("4", "c", "negative", ok, 1), ("4", "c", "negative", ok, 1),  # changed vote
        ("5", "a", "positive", ok, 1), ("5", "b", "positive", ok, 1), ("5", "c", "negative", "pending_review", 1), ("5", "", "negative", ok, 1), ("5", None, "negative", ok, 1), ("5", "d", "mixed", ok, 1),
        (None, "a", "positive", ok, 1), ("6", "a", None, ok, None), ("4", "a", "negative", ok, None),
    ]
    got = sorted((r.id, r.reviewer) for r in consensus.outvoted(votes(spark, data)).collect())
    assert got == [("1", "c"), ("4", "c")]
    assert consensus.outvoted(votes(spark, [])).count() == 0
    assert consensus.discover(votes(spark, [])).reviewers.count() == 0


def test_bad_and_rare_reviewers_weigh_less(spark):
    rng = random.Random(1)
    truth = {str(i): rng.choice(consensus.LABELS) for i in range(400)}
    quality = {"good1": 0.95, "good2": 0.9, "good3": 0.9, "bad1": 0.4, "bad2": 0.4}
    data = []
    for i, t in truth.items():
        for r in rng.sample(sorted(quality), 4):
            data.append((i, r, t if rng.random() < quality[r] else rng.choice([x for x in consensus.LABELS if x != t]), "human_confirmed", 1))
    data.append(("0", "rare", truth["0"], "human_confirmed", 1))
    found = consensus.discover(votes(spark, data))
    weight = {r.reviewer: r.reliability for r in found.reviewers.collect()}
    assert min(weight["good1"], weight["good2"], weight["good3"]) > 2 * max(weight["bad1"], weight["bad2"])
    assert weight["rare"] < weight["bad1"]
    assert found.converged and found.rounds > 2
    # the accuracy measured against the others comes near to the planted one
    accuracy = {r.reviewer: r.accuracy for r in found.reviewers.collect()}
    assert all(abs(accuracy[r] - q) < 0.12 for r, q in quality.items())
    right = sum(truth[r.id] == r.consensus for r in found.items.collect())
    plain = sum(truth[r.id] == r.top_label for r in found.items.collect())
    assert right >= plain and right > 0.9 * len(truth)
