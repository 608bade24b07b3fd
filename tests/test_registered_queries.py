import hashlib
import random

from quern.labels import LABELS
from quern.operators import models
from quern.plans import registry

COMMENTS = "id string, post_id string, text string, label string, source_id string, loaded_at timestamp, collected_at string"


def test_post_components_link_through_unlabelled_comments(spark, tmp_path):
    rows = [
        ("1", " B ", "positive"), ("2", "a", None), ("3", "c", "neutral"), ("4", "d", "odd"), ("5", "e", "negative"),
        ("6", "", None), ("7", "f", "neutral"), ("8", None, "positive"),
    ]
    spark.createDataFrame([(i, p, "t", x, "s", None, None) for i, p, x in rows], COMMENTS).write.parquet(f"{tmp_path}/comments.parquet")
    # b - a - c over the unlabelled 2, d - e over 4; 6 has no post and links nothing; 8 is a post of its own
    pairs = [("1", "2"), ("2", "3"), ("5", "4"), ("6", "7"), ("5", "6"), ("8", "7")]
    spark.createDataFrame(pairs, "id_a string, id_b string").write.parquet(f"{tmp_path}/near_duplicates.parquet")
    got = {r.post_id: r.split_component for r in registry.post_components(spark, str(tmp_path)).collect()}
    root = {"b": "a", "c": "a", "e": "d", "f": "f", "post:8": "f"}
    assert got == {p: "split_component_" + hashlib.sha256(r.encode()).hexdigest()[:16] for p, r in root.items()}


def test_svm_predictions_are_of_the_fitted_svm(spark, tmp_path, monkeypatch):
    rng, fitted, fit = random.Random(1), [], models.fit_linear_svm
    rows = [(str(i), f"p{i}", " ".join(f"w{rng.randrange(30)}" for _ in range(8)), rng.choice(LABELS), "s", None, None) for i in range(60)]
    spark.createDataFrame(rows, COMMENTS).write.parquet(f"{tmp_path}/comments.parquet")
    spark.createDataFrame([(str(i), "test" if i < 10 else "train", "c") for i in range(60)], "id string, split string, split_component string").write.parquet(f"{tmp_path}/split_groups.parquet")
    monkeypatch.setattr(models, "fit_linear_svm", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    assert registry.svm_predictions(spark, str(tmp_path)).count() == 10
    assert [m.gradient_norm <= 1e-4 for m in fitted] == [True]
