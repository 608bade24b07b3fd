import random
import unicodedata

import pytest

from quern.llm import content, groups


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def comments(spark, data, extra=False):
    ddl = "id string, text string" + (", kind string, key string, run string, canonical_id string, n_rows string" if extra else "")
    return spark.createDataFrame([(*r, *(["x"] * 5 if extra else [])) for r in data], ddl)


LONG = "một hai ba bốn năm sáu bảy tám chín"


def test_formatting_differences_are_one_content(spark):
    data = [("02", LONG), ("01", LONG.upper() + "!!"), ("03", "  một hai, ba - bốn; năm (sáu) bảy\ttám chín."), ("04", LONG + " mười"), ("05", "một hai"), ("06", "Một hai")]
    got = rows(content.same_content(comments(spark, data)), "canonical_id", "comment_id")
    assert got == [("01", "02"), ("01", "03")]


def test_entries_in_any_order(spark):
    form = "Lớp: D21; Nội dung: quỹ lớp; Phòng: C4; Giờ: 7h29; Nhóm: Đồi Xám"
    moved = "nhóm: đồi xám\nphòng : c4\n\nlớp:d21\ngiờ: 7h29;nội dung: quỹ lớp"
    same_words = form.replace(":", "").replace(";", "")
    other = "Lớp: D22; Nội dung: quỹ lớp; Phòng: C4; Giờ: 7h29; Nhóm: Đồi Xám"
    two = "một: hai ba bốn; năm: sáu bảy tám chín"
    data = [("1", form), ("2", moved), ("3", same_words), ("4", other), ("5", two), ("6", "năm: sáu bảy tám chín; một: hai ba bốn")]
    got = rows(content.same_content(comments(spark, data)), "canonical_id", "comment_id")
    # 3 has the words of 1 in order, and 1 has the entries of 2; 5 and 6 are no forms
    assert got == [("1", "2"), ("1", "3")]


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    big = "từ " * 200_000
    data = [(None, LONG), ("1", None), ("2", ""), ("3", big), ("4", big + "."), ("4", big + "."), ("5", "...")]
    classes = {r.comment_id: r for r in content.content_classes(comments(spark, data, extra=True)).collect()}
    assert set(classes) == {"1", "2", "3", "4", "5"}
    assert {classes[i].canonical_id for i in "125"} == {"1"}
    assert classes["4"].canonical_id == "3" and classes["4"].n_rows == 2


def test_empty_table(spark):
    assert content.same_content(comments(spark, [])).collect() == []


def test_hot_content_over_many_partitions(spark):
    data = [(f"{i:05d}", LONG if i % 3 else f"khác {i} " + LONG) for i in range(3000)] + [("00001", LONG)] * 500
    df = comments(spark, data).repartition(7)
    got = rows(content.same_content(df), "canonical_id", "comment_id")
    want = sorted(("00001", f"{i:05d}") for i in range(2, 3000) if i % 3)
    assert got == want


def test_copies_count_rows_and_log(spark):
    data = [("1", LONG), ("1", LONG), ("2", LONG + "."), ("3", "khác")]
    log = spark.createDataFrame([("f", 1, " 2 "), ("f", 1, " 2 "), ("f", 2, "'1'"), ("f", 3, "9"), ("g", None, None)], "file_key string, row_number int, comment_id string")
    got = rows(content.copies(comments(spark, data), log), "canonical_id", "n_comments", "n_rows", "n_logged", "n_copies")
    assert got == [("1", 2, 3, 2, 5), ("3", 1, 1, 0, 1)]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        ws = [rng.choice("ab") for _ in range(rng.randint(7, 9))]
        data.append((f"{rng.randint(0, 300):04d}", None))
        data[-1] = (data[-1][0], rng.choice([" ", ", ", "\n", " - "]).join(ws) + rng.choice(["", ".", "!"]))
    first = {}
    data = [d for d in data if first.setdefault(d[0], d[1]) == d[1]]
    norm = lambda t: "".join(" " if unicodedata.category(c)[0] == "P" or c.isspace() else c for c in t).split()
    least = {}
    for i, t in data:
        k = " ".join(norm(t))
        least[k] = min(least.get(k, i), i)
    want = sorted({(least[" ".join(norm(t))], i) for i, t in data if len(norm(t)) >= 8 and least[" ".join(norm(t))] != i})
    assert rows(content.same_content(comments(spark, data)), "canonical_id", "comment_id") == want


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent if find(x) != x)


def links(spark, pairs):
    return spark.createDataFrame([(a, b, 0.9, "x") for a, b in pairs], "id_a string, id_b string, similarity double, v string")


GRAPHS = {
    "one": [("1", "2")],
    "cycle": [(str(i), str((i + 1) % 9)) for i in range(9)],
    "path": [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)],
    "star": [("000", f"{i:03d}") for i in range(1, 120)],
    "cycle with tails": [(f"{i:02d}", f"{(i + 1) % 12:02d}") for i in range(12)] + [("03", "a"), ("a", "b"), ("c", "d"), ("d", "e"), ("e", "c")],
    "dirty": [(" 1", "2 "), ("2", "1"), ("3", None), ("", "4"), ("5", "5"), ("6 ", "7"), (None, None)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_groups(spark, name):
    assert rows(groups.group_members(links(spark, GRAPHS[name])), "group_id", "id") == brute([(a and a.replace(" ", ""), b) for a, b in GRAPHS[name]])


@pytest.mark.parametrize("n,m", [(60, 55), (40, 200)])
def test_random_groups(spark, n, m):
    rng = random.Random(n)
    pairs = [(f"{rng.randrange(n):03d}", f"{rng.randrange(n):03d}") for _ in range(m)]
    assert rows(groups.group_members(links(spark, pairs)), "group_id", "id") == brute(pairs)


def test_no_links(spark):
    assert groups.linked_groups(links(spark, [])).collect() == []
