import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.operators import duplicates, quality, set_join
from quern.streaming import ingest


def table(spark, rows, ddl="id string, post_id string, text string, label string"):
    return spark.createDataFrame(rows, ddl)


def rules(df, **options):
    return sorted((r.rule, r.id) for r in quality.violations(df, **options).collect())


def test_violations(spark):
    rows = [("1", "p", "Hay  quá", "positive"), ("2", "p", "hay quá", "neutral"), ("3 ", " p", " ", "bad"), ("4", None, "a�", ""), ("4", "p", "x", "negative")]
    got = rules(table(spark, rows))
    assert got == sorted([("duplicate_text", "1"), ("duplicate_text", "2"), ("blank_text", "3 "), ("edge_space_id", "3 "), ("edge_space_post_id", "3 "), ("unknown_label", "3 "), ("blank_post_id", "4"), ("blank_label", "4"), ("replacement_character", "4"), ("unknown_label", "4"), ("duplicate_id", "4"), ("duplicate_id", "4")])
    assert rules(table(spark, [])) == [("empty", None)]
    assert rules(table(spark, [("1", "a")], "id string, body string"), labelled=False) == [("missing_column", None)]
    ok = table(spark, [("001", "01", "NA", "neutral")])
    assert quality.assert_valid(ok) is ok
    with pytest.raises(ValueError, match="unknown_label"):
        quality.assert_valid(table(spark, [("1", "p", "t", "x")]))


def test_statistics(spark):
    df = table(spark, [("1", "p", "a", "positive"), ("2", "q", "b", None), ("3", None, "c", "other")])
    assert quality.statistics(df).first().asDict() == {"rows": 3, "posts": 2, "n_positive": 1, "n_neutral": 0, "n_negative": 0}
    assert {r.post_id: (r.positive, r.neutral, r.negative) for r in quality.label_by_group(df).collect()} == {"p": (1, 0, 0), "q": (0, 0, 0), None: (0, 0, 0)}
    assert quality.statistics(table(spark, [])).first()["rows"] == 0
    got = {r.metric: r.value for r in quality.split_profile(df).collect()}
    assert got["rows"] == 3 and got["null_label"] == 1 and got["label_other"] == 2 and got["repeated_texts"] == 0


def test_audit(spark):
    rows = [(1, "a", "p", "😢"), (2, "", "", "vui"), (3, "b", "p", "..."), (4, "c", "p", "https://x.y"), (5, "d", "p", "một"), (6, "d", "p", "hai"), (7, "d", "p", "hai"), (8, "e", "p", "x"), (9, "e", "p", "x"), (10, " f", "p", None), (11, "g", "p", "=1")]
    out = quality.audit(table(spark, rows, "seq long, id string, post_id string, text string"), file_hash=F.lit("h"))
    got = {r.seq: r for r in out.collect()}
    reasons = {k: v.reasons for k, v in got.items()}
    assert reasons == {
        1: [], 2: [], 3: ["punctuation_only_no_sentiment_evidence"], 4: ["url_only"], 5: ["conflicting_id"], 6: ["conflicting_id"], 7: ["duplicate_id"], 8: [], 9: ["duplicate_id"],
        10: ["empty_text", "identifier_whitespace_requires_source_correction"], 11: [],
    }
    assert got[2].id.startswith("internal:") and len(got[2].id) == 29 and got[2].source_comment_id == "" and got[2].id_origin == "internal_missing_source_id"
    assert got[11].audit_flags == ["excel_import_as_text_required"]
    assert quality.clean_rows(out).count() == 4 and quality.excluded_rows(out).count() == 7
    assert quality.audit(table(spark, [], "seq long, id string, post_id string, text string")).count() == 0


def test_origins_and_reconciliation(spark):
    rows = [("1", "ai", "ai_labeled", None), ("2", "human", "human_confirmed", "r"), ("3", "ai", "human_confirmed", "r"), ("4", "human", "human_confirmed", " "), ("5", "ai", "pending", None)]
    bad = quality.origins_invalid(table(spark, rows, "id string, label_source string, annotation_status string, reviewer string"))
    assert sorted(r.id for r in bad.collect()) == ["3", "4", "5"]
    ddl = "id string, post_id string, text string"
    raw = table(spark, [("1", "p", "a"), ("2", "p", "b"), ("3", "p", "c")], ddl)
    parts = {"x": table(spark, [("1", "p", "a"), ("2", "p", "changed")], ddl), "y": table(spark, [("1", "p", "a"), ("9", "p", "z")], ddl)}
    assert sorted((r.id, r.problem) for r in quality.reconcile(raw, parts).collect()) == [("1", "repeated"), ("2", "changed"), ("3", "lost"), ("9", "not_in_source")]


def test_exact_duplicates(spark):
    df = table(spark, [(1, "b", "Vui  lắm"), (2, "a", "vui lắm"), (3, "c", "khác"), (4, "d", None), (5, "e", None)], "seq long, id string, text string")
    got = duplicates.duplicate_groups(df).collect()
    assert [(r.n, r.first_id, r.last_id) for r in got] == [(2, "a", "b")]
    assert sorted((r.id, r.canonical_id) for r in duplicates.first_canonical(df).collect()) == [("a", "b"), ("b", "b")]


def near_by_brute_force(rows):
    keys = [(i, " ".join((t or "").casefold().split())) for i, t in rows]
    seen, out = {}, []
    for i, k in keys:
        if len(k) >= 12:
            seen.setdefault(k, i)
    firsts = [(i, k) for k, i in seen.items()]
    firsts.sort(key=lambda x: x[0])
    for a in range(len(firsts)):
        for b in range(a + 1, len(firsts)):
            (ia, ka), (ib, kb) = firsts[a], firsts[b]
            ta, tb = set(ka.split()), set(kb.split())
            if min(len(ka), len(kb)) / max(len(ka), len(kb)) < 0.8 or 5 * len(ta & tb) < 3 * len(ta | tb):
                continue
            r = SequenceMatcher(None, ka, kb, autojunk=False).ratio()
            if r >= 0.9:
                out.append((ia, ib, round(r, 5)))
    return sorted(out)


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(7)
    vocab = ["w%02d" % i for i in range(40)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 15))]
        texts += [" ".join(base), " ".join(rng.choice(vocab) if rng.random() < 0.1 else w for w in base), " ".join(base).upper()]
    rows = [(f"{i:03d}", t) for i, t in enumerate(texts)] + [("900", None), ("901", ""), ("902", "ngắn")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "id string, text string, seq string, key string")
    got = sorted((r.id_a, r.id_b, r.similarity) for r in duplicates.near_pairs(df).collect())
    assert got == near_by_brute_force(rows) and got
    assert duplicates.near_pairs(df.limit(0)).count() == 0


def test_captures(spark):
    ddl = "id string, post_id string, text string"
    main = table(spark, [("1", "p", "Vui"), ("2", "p", "b")], ddl)
    caps = table(spark, [("1", "p", "Vui"), ("2", "q", "b"), ("3", "p", "VUI "), ("4", "p", "mới")], ddl)
    assert {r.id: (r.relationship, r.canonical_id) for r in duplicates.historical_duplicates(caps, main).collect()} == {"1": ("same_id", "1"), "2": ("conflicting_id", "2"), "3": ("historical_content", "1"), "4": ("new_content", None)}


def judge_by_brute_force(rows, store=()):
    ids, keys, out = {}, set(), {}
    for i, p, t in store:
        ids[i] = (p, t)
        keys.add(" ".join(t.casefold().split()))
    for seq, i, p, t in sorted(rows):
        i, p, t = i or "", p or "", t or ""
        k = " ".join(t.casefold().split())
        if not i.strip() or not p.strip() or not t.strip():
            out[seq] = ("rejected", "missing_field")
        elif i != i.strip() or p != p.strip():
            out[seq] = ("rejected", "edge_space")
        elif i in ids:
            out[seq] = ("duplicate", None) if ids[i] == (p, t) else ("rejected", "conflicting_id")
        elif k in keys:
            out[seq] = ("duplicate", None)
        else:
            ids[i] = (p, t)
            keys.add(k)
            out[seq] = ("accepted", None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ingest_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(n, rng.choice(["a", "b", "c", "d", "e", "f", "g", " a", ""]), rng.choice("pq"), rng.choice(["X", "x", "y", "z", "u v", "U  v", None, "w", "t", "s"])) for n in range(60)]
    store = [("a", "p", "y"), ("k", "p", "u v")] if seed % 2 else []
    df = spark.createDataFrame([(*r, "h") for r in rows], "seq long, id string, post_id string, text string, reason string")
    kept = spark.createDataFrame(store, "id string, post_id string, text string") if store else None
    got = {r.seq: (r.state, r.reason) for r in ingest.judge(df, kept).collect()}
    assert got == judge_by_brute_force(rows, store)


def test_ingest_chain(spark):
    # 2 repeats the content of 1, so its id is judged afresh later
    rows = [(1, "a", "p", "x"), (2, "b", "p", "X"), (3, "b", "p", "y"), (4, "b", "p", "z"), (5, "c", "p", "Y")]
    got = {r.seq: r.state for r in ingest.judge(spark.createDataFrame(rows, "seq long, id string, post_id string, text string")).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "rejected", 5: "duplicate"}


def test_target(spark):
    rows = [(n, f"i{n % 7}", "p", f"t{n % 7}") for n in range(20)]
    judged = ingest.judge(spark.createDataFrame(rows, "seq long, id string, post_id string, text string"))
    kept = ingest.up_to_target(judged, 5).collect()
    assert max(r.seq for r in kept) == 4 and sum(r.state == "accepted" for r in kept) == 5


def test_stream_imports_each_file_once(spark, tmp_path):
    from quern.sources.tables import exists

    src, store, mark = (str(tmp_path / n) for n in ("src", "store", "mark"))
    ddl = "file_key string, row_number int, id string, post_id string, text string"
    spark.createDataFrame([("f1", 1, "001", "p", "một"), ("f1", 2, "002", "p", "hai"), ("f1", 3, "002", "q", "hai")], ddl).coalesce(1).write.parquet(src)
    ingest.stream_exports(spark, src, ddl, store, mark).awaitTermination()
    spark.createDataFrame([("f2", 1, "003", "p", "MỘT"), ("f2", 2, "004", "p", "bốn")], ddl).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest.stream_exports(spark, src, ddl, store, mark).awaitTermination()
    assert exists(spark, store)
    read = lambda n: sorted(r.id for r in spark.read.parquet(f"{store}/{n}").collect())
    assert read("comments") == ["001", "002", "004"] and read("duplicates") == ["003"] and read("rejected") == ["002"]


def test_set_join_forms_few_candidates_and_loses_no_pair(spark):
    # texts of common words only: one key of two words is shared by nearly all pairs
    rng = random.Random(3)
    vocab = ["w%03d" % i for i in range(150)]
    sets = [rng.sample(vocab, 40) for _ in range(300)]
    sets += [[*s[:-4], *(w + "x" for w in s[-4:])] for s in sets[:60]] + [["a", "b", "c"], ["a", "b", "c", "d"], ["e"], ["e", "f"]]
    rows = [(n, 100, s) for n, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "cid long, len int, w array<string>").select("cid", "len", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    got = {(r.a, r.b) for r in set_join.candidates(df, len(rows)).collect()}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len({*sets[i]} & {*sets[j]}) >= 3 * len({*sets[i]} | {*sets[j]})}
    assert near <= got and len(near) > 60 and len(got) < 4 * len(near)


def test_ratio_is_that_of_difflib():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        b = "".join(rng.choice("abc ") if rng.random() < 0.08 else c for c in a if rng.random() > 0.03) or "a"
        r = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert duplicates.ratio(a, b, 0.0) == r
        assert duplicates.ratio(a, b, 0.9) == (r if r >= 0.9 else 0.0)
