import random
from datetime import datetime

import pytest

from quern.sources import raw_records as R

GOOD = '001,7,"a, ""b""\nc",neutral,2025-10-03T13:24:28+00:00'


def machine(raw):
    """Fields by a character-by-character reading, or None for broken quoting."""
    raw = raw or ""
    raw = raw[:-1] if raw.endswith("\n") else raw
    raw = raw[:-1] if raw.endswith("\r") else raw
    out, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            i, f = i + 1, ""
            while True:
                if i >= n:
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        f, i = f + '"', i + 2
                        continue
                    i += 1
                    break
                f, i = f + raw[i], i + 1
            if i < n and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = n if j < 0 else j
            f, i = raw[i:j], j
            if any(c in f for c in '"\r\n'):
                return None
        out.append(f)
        if i >= n:
            return out
        i += 1


def parse(spark, raws):
    df = spark.createDataFrame([("f", i, r, "x", "y") for i, r in enumerate(raws)], "file_key string, row_number int, raw string, reason string, text string")
    return {r.row_number: r for r in R.parse_records(df).collect()}


CASES = [
    (GOOD, None), (GOOD + "\n", None), (GOOD + "\r\n", None), (GOOD.replace("neutral", ""), None), (GOOD.replace("neutral", '"neutral"'), None),
    (GOOD.replace("neutral", '"neutral'), "quoting"), (GOOD.replace("neutral", 'neu"tral'), "quoting"), (GOOD.replace("neutral", '"neutral" x'), "quoting"), ("1,2,a\nb,,2025-10-03T13:24:28Z", "quoting"),
    (GOOD + ",", "column_count"), ("a;b;c;d;e", "column_count"), ("", "column_count"), (None, "column_count"), ("# hết tệp", "column_count"),
    (GOOD.replace("001", ""), "invalid_value"), (GOOD.replace("001", "001 "), "invalid_value"), (GOOD.replace("001", " "), "invalid_value"), (GOOD.replace(",7,", ",\t7,"), "invalid_value"),
    ("1,2, \n,,2025-10-03T13:24:28Z".replace(" \n", '" \n"'), "invalid_value"), (GOOD.replace("b", "�"), "invalid_value"), (GOOD.replace("neutral", "Neutral"), "invalid_value"),
    ("id,post_id,text,label,collected_at", "invalid_value"), ("1,2,NA,,2025-10-03T13:24:28Z", None), ("1,2,null,,2025-10-03T13:24:28.123456+07:00", None),
]


def test_cases(spark):
    got = parse(spark, [c for c, _ in CASES])
    assert {i: r.reason for i, r in got.items()} == {i: w for i, (_, w) in enumerate(CASES)}
    assert (got[0].id, got[0].text, got[0].collected_at) == ("001", 'a, "b"\nc', "2025-10-03T13:24:28+00:00")
    assert got[5].id is None


@pytest.mark.parametrize(
    "when,ok",
    [
        ("2025-10-03T13:24:28Z", True), ("20251003T132428Z", True), ("2025-10-03T13:24", True), ("2025-10-03T24:00:00Z", True), ("2024-02-29T00:00:00Z", True), ("2025-W40-5T10:00", True), ("2025-276T10:00Z", True),
        ("2025-10-03", False), ("2025-10-03 13:24:28", False), ("2026-02-30T10:00:00Z", False), ("2026-13-01T00:00:00Z", False), ("2026-03-04T25:10:00Z", False), ("2025-02-29T00:00:00Z", False), ("2026-03-04T10:60:00Z", False),
        ("", False), ("hôm qua", False), ("0", False), ('2026-05-03T21:52:05+07:00"', False), ("2026-05-03T21:52:05+24:00", False), ("2025-366T10:00Z", False),
    ],
)
def test_times(when, ok):
    import pyarrow as pa

    assert R.iso_8601(pa.array([when])).tolist() == [ok]


def test_random_records_against_the_machine(spark):
    rng = random.Random(8)
    raws = []
    for _ in range(1500):
        s = GOOD
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + rng.choice(['"', ",", "\n", '""', " ", '","', "x", "é", ""]) + s[k + rng.randrange(3) :]
        raws.append(s)
    got = parse(spark, raws)
    for i, raw in enumerate(raws):
        f = machine(raw)
        if f is None:
            assert got[i].reason == "quoting", raw
        elif len(f) != 5:
            assert got[i].reason == "column_count", raw
        elif got[i].reason is None:
            assert [got[i].id, got[i].post_id, got[i].text, got[i].label, got[i].collected_at] == f
            assert datetime.fromisoformat(f[4].replace("Z", "+00:00"))


def test_empty_long_and_repeated(spark):
    df = spark.createDataFrame([("f", 1, "x"), ("f", 1, "x"), ("f", None, "1,2," + "a" * 3_000_000 + ",,2025-10-03T13:24:28Z")], "file_key string, row_number int, raw string")
    assert R.rejected_rows(df).count() == 1 and R.loaded_rows(df).count() == 1
    assert R.rejected_rows(df.limit(0)).count() == 0


def test_files_are_cut_into_records(spark, tmp_path):
    from quern.sources.raw_records import read_raw_files

    (tmp_path / "a.csv").write_bytes("\ufeffid,post_id,text,label,collected_at\r\n1,p,\"có\nhai dòng, \"\"nháy\"\"\",,2026-01-02T03:04:05Z\r\n\n2,p,x".encode())
    (tmp_path / "b.csv").write_bytes(b'h\n1,"open\n2,x\n')
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"h\r1\r\n\xff")
    got = {}
    for r in read_raw_files(spark, str(tmp_path)).collect():
        got.setdefault(r.file_key, {})[r.row_number] = r.raw
    assert got == {
        "a.csv": {1: '1,p,"có\nhai dòng, ""nháy""",,2026-01-02T03:04:05Z', 2: "", 3: "2,p,x"},
        "b.csv": {1: '1,"open\n2,x\n'},
        "d.csv": {1: "1", 2: "\ufffd"},
    }


def test_weeks_of_a_year():
    import pyarrow as pa

    from quern.sources.raw_records import iso_8601

    assert iso_8601(pa.array(["2020-W53-1T00:00Z", "2021-W53-1T00:00Z", "2015-W53-7T00:00Z", "2026-W53-1T00:00Z", "2024-W53-1T00:00Z", "2024-W52-1T00:00Z"])).tolist() == [True, False, True, True, False, True]
