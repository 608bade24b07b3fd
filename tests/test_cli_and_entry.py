import json

import __spark_entry__ as entry
from quern.__main__ import main


def test_command_line(spark, tmp_path, capsys):
    src = str(tmp_path / "rows")
    labels = ("positive", "neutral", "negative")
    words = {"positive": "vui", "neutral": "hỏi", "negative": "chán"}
    spark.createDataFrame([(f"{p}-{x}", f"{p:02d}", f"{words[x]} lắm {p} {x}", x) for p in range(12) for x in labels], "id string, post_id string, text string, label string").write.parquet(src)
    assert main(["validate", "--input", src]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 36
    splits, model = str(tmp_path / "splits"), str(tmp_path / "model")
    assert main(["split", "--input", src, "--output", splits, "--attempts", "64"]) == 0
    assert main(["split", "--input", src, "--output", splits]) == 1  # never overwritten
    assert main(["train", "--input", splits, "--output", model, "--feature", "bow", "--algorithm", "nb"]) == 0
    capsys.readouterr()
    assert main(["predict", "--text", "vui", "--model", model]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["predicted_label"] == "positive"
    (tmp_path / "x.csv").write_text("cid,pid,body\n01,p,một\n01,p,một\n,p,x\n")
    args = ["collect", "--input", str(tmp_path / "x.csv"), "--output", str(tmp_path / "store"), "--batch", "b1"]
    assert main(args) == 1
    capsys.readouterr()
    assert main([*args, "--column", "id=cid", "--column", "post_id=pid", "--column", "text=body"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"comments": 1, "duplicates": 1, "rejected": 1}


def test_entry_is_complete(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "p5_found" in queries
    assert entry.entry(spark).columns == ["file_key", "row_number", "reason"]
