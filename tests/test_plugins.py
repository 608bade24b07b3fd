import pytest

from quern.operators import encode, models, split
from quern.streaming import ingest


def texts(spark):
    return spark.createDataFrame([("1", "a b"), ("2", "a b c"), ("3", None)], "id string, text string")


def test_encode_and_truncation(spark):
    make = lambda: lambda ts: [[len(w) for w in t.split()] for t in ts]
    out = encode.encode(texts(spark), make, 4, 0, 2)
    got = {r.id: (r.input_ids, r.attention_mask, r.n_tokens) for r in out.collect()}
    assert got == {"1": ([0, 1, 1, 2], [1] * 4, 4), "2": ([0, 1, 1, 2], [1] * 4, 5), "3": ([0, 2], [1, 1], 2)}
    assert models.truncation(out, 4).first().n_truncated == 1
    with pytest.raises(ValueError):
        encode.encode(texts(spark), make, 2, 0, 2)


def test_predict_batches(spark):
    make = lambda: lambda ts: [[len(t), 2, 2] for t in ts]
    got = {r.id: r for r in encode.predict_batches(texts(spark), make, 2).collect()}
    assert {i: r.predicted_label for i, r in got.items()} == {"1": "positive", "2": "positive", "3": "neutral"}
    assert sum(got["2"].probabilities.values()) == pytest.approx(1)
    with pytest.raises(Exception, match="shape"):
        encode.predict_batches(texts(spark), lambda: lambda ts: [[1]] * len(ts)).collect()


def test_confirmed_rows_only(spark):
    rows = [(f"{p}-{x}", f"{p:02d}", f"t {p} {x}", x, "human_confirmed") for p in range(9) for x in ("positive", "neutral", "negative")]
    ddl = "id string, post_id string, text string, label string, annotation_status string"
    none = spark.createDataFrame([], "id_a string, id_b string")
    out = split.split_confirmed(spark.createDataFrame(rows, ddl), none, attempts=50)
    a = out.where("split = 'train'").first().id
    b = out.where("split = 'test'").first().id
    with pytest.raises(ValueError, match="different splits"):
        split.split_confirmed(spark.createDataFrame(rows, ddl), spark.createDataFrame([(a, b)], "id_a string, id_b string"), attempts=50)
    with pytest.raises(ValueError, match="confirmed"):
        split.split_confirmed(spark.createDataFrame([*rows, ("x", "99", "y", "neutral", "pending_review")], ddl), none)


def test_checkpoints(spark):
    rows = spark.createDataFrame([("f", n, "h", str(n)) for n in range(1, 6)] + [("g", 1, "k", "x")], "file_key string, row_number int, sha256 string, id string")
    marks = spark.createDataFrame([("f", "h", 3)], "file_key string, sha256 string, row_offset int")
    new = ingest.after_checkpoint(rows, marks)
    assert sorted((r.file_key, r.row_number) for r in new.collect()) == [("f", 4), ("f", 5), ("g", 1)]
    assert sorted(map(tuple, ingest.next_checkpoints(marks, new).collect())) == [("f", "h", 5), ("g", "k", 1)]
    with pytest.raises(ValueError, match="changed"):
        ingest.after_checkpoint(rows, spark.createDataFrame([("f", "other", 1)], "file_key string, sha256 string, row_offset int"))
