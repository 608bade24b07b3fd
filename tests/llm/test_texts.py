import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import leakage, lookalike, mixing, overlap, personal
from quern.llm.crf import Crf
from quern.llm.personal_samples import COMMON, CUES, FAMILY, KINDS, MIDDLE, THINGS, TITLES, bare, labelled_table, syllables
from quern.llm.queries import VOCABULARY
from quern.llm.tokens import split_words


def docs(spark, data):
    return spark.createDataFrame([(*r, "s", "x", "y") for r in data], "doc_id long, text string, source string, form string, raw string")


def pairs(df, a, b):
    return sorted((r[a], r[b]) for r in df.collect())


def form(spark, *texts):
    return [r.form for r in lookalike.one_form(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]


def test_forms(spark):
    same = ["Đọc kỹ bài 2", "Đọc kỹ bài 2", "Ɖọc kỹ bài　2", "Ðọc k​ỹ b­ài 2﻿", "Đọc kỹ bài ２", "Đọс kỹ bài 2"]
    assert set(form(spark, *same)) == {same[0]}
    other = ["Đọc kỹ bài ²", "đọc kỹ bài 2", "Đoc kỹ bài 2", "Đọc kỹ\nbài 2", "Đọc kỹ bài 2 ❤️", "Đọc kỹ bài 2 👨‍👩‍👧", "Đọc kỹ bài 2 👨👩👧"]
    assert len(set(form(spark, same[0], *other))) == len(other) + 1
    assert form(spark, None, "") == [None, ""]
    # private use characters and others without a rule stay
    kept = ["\ue000x", "ı", "ſ", "½", "…", "❤️", "🏴\U000e0067\U000e0062\U000e007f", "x\u2028y"]
    assert form(spark, *kept) == kept
    want = {"ﬁn": "fin", "Ⅱ": "II", "ｶﾞ": "ガ", "𝐀𝐛": "Ab", "ꓮꓐ": "AB", "e\ufe0f": "e", "ё Ё ό ӑ": "ë Ë ó ă", "a\U000e0041b": "ab", "a\u200d\u200db": "ab", "￥": "¥"}
    assert form(spark, *want) == list(want.values())


def test_alike_pairs(spark):
    data = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "а b"), (5, "A b"), (6, None), (None, "a b"), (7, ""), (8, "​"), (2, "a b")]
    got = pairs(lookalike.alike_pairs(docs(spark, data)), "doc_id_a", "doc_id_b")
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert lookalike.alike_pairs(docs(spark, [])).count() == 0


def words(s):
    return "".join(" " if unicodedata.category(c)[0] == "P" or c.isspace() else c for c in s.lower()).split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .,-– \nđĐ😊é", max_size=30), max_size=6))
def test_split_words(texts):
    h, doc, _, _ = split_words(pa.array(texts, pa.string()))
    want = [(d, w) for d, t in enumerate(texts) for w in words(t)]
    assert list(doc) == [d for d, _ in want]
    by = {}
    for x, (_, w) in zip(h.tolist(), want):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_against_brute_force(seed):
    rng = random.Random(seed)
    least = rng.choice([2, 3, 4, 5, 12])
    make = lambda n: [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(n)]
    corpus, items = make(30), make(8)
    w, d, _, _ = split_words(pa.array(corpus))
    hits = leakage.search(w, d, leakage.passages(list(range(len(items))), items), least)
    got = {} if hits is None else {(r["doc"], r["item_id"]): r["n_words"] for r in hits.to_pylist()}
    want = {}
    for i, c in enumerate(corpus):
        for j, t in enumerate(items):
            x, y = c.split(), t.split()
            best = max((k for a in range(len(x)) for b in range(len(y)) for k in [next((m for m in range(min(len(x) - a, len(y) - b)) if x[a + m] != y[b + m]), min(len(x) - a, len(y) - b))]), default=0)
            if best >= least:
                want[i, j] = best
    assert got == want


def test_leaks(spark):
    passage = "một hai ba bốn năm sáu bảy tám chín mười mười-một mười-hai mười-ba"
    items = spark.createDataFrame([(1, passage, "test", 5), (2, "ngắn", "test", 5), (3, None, "test", 5)], "item_id long, text string, split string, doc_id int")
    data = [(1, "trước " + passage.upper().replace(" ", " , ") + " sau"), (2, passage.replace("b", "b​")), (3, "một hai ba"), (4, None), (5, ""), (6, "x " * 300_000 + passage), (7, passage[:-20]), (1, "trước " + passage)]
    got = set(pairs(leakage.leaked(docs(spark, data), items), "doc_id", "item_id"))
    assert got == {(1, 1), (2, 1), (6, 1)}
    assert leakage.leaked(docs(spark, []), items).count() == 0 and leakage.leaked(docs(spark, data), items.limit(0)).count() == 0
    left = leakage.without_leaks(docs(spark, data), leakage.leaked(docs(spark, data), items))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(20)], "item_id long, text string")
    data = [(i, f"y {' '.join(f'w{i}x{k}' for k in range(13))}") for i in range(20)]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 200)
    assert pairs(leakage.leaked(docs(spark, data), items), "doc_id", "item_id") == [(i, i) for i in range(20)]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(400)]
    texts = []
    for i in range(150):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 40))]
        texts.append(base)
        for _ in range(2):
            texts.append([rng.choice(vocab) if rng.random() < rng.choice([0.02, 0.08, 0.15]) else w for w in base])
    rows = [(f"{i:04d}", rng.choice(["train", "train", "validation", "test"]), " ".join(t)) for i, t in enumerate(texts)]
    rows += [("0000", "test", "ngắn quá"), ("9998", "train", None), ("9999", "test", "")]
    split = spark.createDataFrame([(i, s, 1) for i, s, _ in rows] + [(None, "train", 1), ("x", None, 1)], "id string, split string, cls int")
    texts_df = spark.createDataFrame([(i, t, "n") for i, _, t in rows], "id string, text string, num string")
    found = overlap.split_overlaps(split, texts_df)
    got = pairs(found, "id_a", "id_b")
    sides = {}
    for i, s, _ in rows:
        sides.setdefault(i, set()).add(s)
    long = [(i, s, set(words(t))) for i, ss in sides.items() for s in ss for j, _, t in rows if j == i and t and len(words(t)) >= 8]
    want = sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in long for b in long if a[1] == "train" != b[1] and a[0] != b[0] and 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2])})
    assert got == want and len(want) > 50
    report = overlap.overlap_report(split, texts_df.withColumn("source_id", F.lit("s"))).collect()
    ends = {(i, s) for i, ss in sides.items() for s in ss if s != "train"}
    count = {(i, s): len({p for p in want if i in p and "train" in sides[p[0] if p[1] == i else p[1]]}) for i, s in ends}
    assert {r.split: (r.n_records, r.n_pairs) for r in report} == {s: (sum(1 for (i, t), n in count.items() if t == s and n), sum(n for (i, t), n in count.items() if t == s)) for s in ("validation", "test")}


def test_overlaps_of_nothing(spark):
    split = spark.createDataFrame([], "id string, split string")
    texts = spark.createDataFrame([], "id string, text string, source_id string")
    assert overlap.split_overlaps(split, texts).count() == 0 and overlap.overlap_report(split, texts).count() == 0


def test_band_recall():
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 48).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 6).astype(np.uint64)]) for _ in range(2))  # similarity 0.8
        hit += any((overlap.band_keys(overlap.signatures(np.concatenate([a, b]), np.array([0, 54]), t), t).reshape(2, -1)[0] == overlap.band_keys(overlap.signatures(np.concatenate([a, b]), np.array([0, 54]), t), t).reshape(2, -1)[1]).any() for t in range(overlap.PASSES))
    assert hit >= 299


def test_mix(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["một", "hai", "ba"]) for _ in range(rng.randint(5, 60))), s) for i, s in enumerate(["Lon"] * 600 + ["lon "] * 200 + ["nho_be"] * 30 + ["khac"] * 100)] + [(9000, None, "lon"), (9001, "", "lon"), (None, "x", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    t = spark.createDataFrame([("lon", 0.5, 1), ("nho-be", 0.06, 3), ("thieu", 0.1, 2), ("khac", 0.2, 2)], "source string, target_share double, max_repeats int")
    m, s = mixing.mix(d, t, block_tokens=200, vocabulary=VOCABULARY)
    assert {r.rule: r.n_broken for r in mixing.broken_rules(m, s, 200).collect()} == dict.fromkeys(["shared_slot", "missing_slot", "uneven_block", "gap", "taken_too_often", "over_share"], 0)
    m, s = m.toPandas(), s.toPandas().set_index("source")
    total = s.tokens.sum()
    longest = m.groupby(["source", "doc_id", "repeat"]).n_tokens.sum().max()
    for name, share in (("lon", 0.5), ("khac", 0.2), ("nho-be", 0.06)):
        assert abs(s.taken_tokens[name] - share * total) <= longest / 2 + 1
    assert m.groupby(["source", "doc_id"]).repeat.nunique().groupby("source").max().to_dict() == {"khac": 2, "lon": 1, "nho-be": 2}
    assert s.taken_tokens["thieu"] == 0 and s.short["thieu"] and not s.short["lon"]
    assert m.n_tokens.sum() == s.taken_tokens.sum() and total > 0
    # the blocks are of one size, the sources are spread evenly: each half of the mix has about the shares of the whole
    sizes = m.groupby("slot").n_tokens.sum()
    assert (sizes == 200).sum() >= len(sizes) - m.source.nunique() and sorted(sizes.index) == list(range(len(sizes)))
    m = m.sort_values(["slot", "place"])
    half = m[m.n_tokens.cumsum() <= m.n_tokens.sum() / 2]
    assert abs(half[half.source == "lon"].n_tokens.sum() / half.n_tokens.sum() - s.actual_share["lon"]) < 0.05
    assert mixing.mix(d.limit(0), t, vocabulary=VOCABULARY)[0].count() == 0 and mixing.mix(d, t.limit(0), vocabulary=VOCABULARY)[0].count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 65536])
def test_golden_points_hit_every_block_once(n):
    points = mixing.golden_points(np.arange(n), n, mixing.golden_step(n))
    assert sorted(points.tolist()) == list(range(n))


def test_golden_points_of_large_numbers():
    n = (1 << 41) + 7
    step = mixing.golden_step(n)
    slots = np.array([0, 1, 12345678901, n - 1])
    assert mixing.golden_points(slots, n, step).tolist() == [int(x) * step % n for x in slots]


def test_token_counts_match_the_tokenizer(spark):
    enc = mixing.encoding(VOCABULARY)
    texts = ["Xin chào các bạn!", "", None, "<|endoftext|> 😊"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(d, ["doc_id"], vocabulary=VOCABULARY).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[0])) == texts[0]


@pytest.fixture(scope="module")
def tagger(spark):
    return personal.loaded(personal.fitted(spark))


def test_training_and_held_out_words_are_disjoint():
    words = [{w for t, _ in labelled_table(300, 5, held) for w in t.split()} for held in (False, True)]
    assert not set(syllables(False)) & set(syllables(True))
    shared = {w.lower() for w in words[0] & words[1] if w.isalpha()}
    closed = {w.lower() for x in (FAMILY, MIDDLE, COMMON, CUES, TITLES, *(t.split() for t in THINGS)) for w in x}
    # what both halves share beside the closed classes are the words before codes and numbers
    assert len(shared - closed - {bare(c) for c in closed}) < 250


def test_crf_gradient():
    rng = np.random.default_rng(0)
    crf = Crf(6, 3)
    crf.emit[:-1] = rng.normal(size=(6, 3))
    crf.trans[:], crf.start[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    feats, labels, lengths = rng.integers(0, 7, (2, 4, 2)), rng.integers(0, 3, (2, 4)), np.array([4, 3])
    value, g_emit, g_trans, g_start = crf.gradient(feats, labels, lengths)
    assert value < 0
    for param, grad in ((crf.emit, g_emit), (crf.trans, g_trans), (crf.start, g_start)):
        at = (0,) * param.ndim
        param[at] += 1e-2
        up = crf.gradient(feats, labels, lengths)[0]
        param[at] -= 2e-2
        down = crf.gradient(feats, labels, lengths)[0]
        param[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 1e-2


def test_saved_tagger_is_the_same_and_found_again(spark, tagger, tmp_path):
    texts = pa.array([t for t, _ in labelled_table(60, 9)])
    assert personal.Tagger.load(tagger.state()).find(texts) == tagger.find(texts)
    path = f"file://{tmp_path}/tagger"
    small = personal.fitted(spark, path, samples=60, epochs=1)
    assert personal.fitted(spark, path) == small  # what is saved is not trained again


def test_held_out_accuracy(tagger):
    held = labelled_table(800, seed=4242, held=True)
    found = {(d, k) for d, _, _, k in tagger.find(pa.array([t for t, _ in held]))}
    want = {(d, k) for d, (_, s) in enumerate(held) for _, _, k in s}
    for kind in KINDS:
        f, w = ({x for x in s if x[1] == kind} for s in (found, want))
        assert len(f & w) / len(w) > 0.93, kind
        assert len(f & w) / len(f) > 0.93, kind


def test_no_cases(tagger):
    texts = ["mã giao dịch 256033093835884", "đơn hàng #45207833", "xem https://tin-9.example/bai/62885476", "@lop.2k", "giá 25.250.000đ", "tài liệu v6.6.46", "ngày 12-08-2026", "lớp D21-34, phòng C4-126", "ngõ nào gần nhất", "hôm qua ghé quán Hoàng Lan ăn trưa", "mã hồ sơ 2061488220"]
    assert tagger.find(pa.array(texts)) == []


def test_masked(spark):
    data = [("1", "gọi 0954 612 596 gặp mình, mail mình bich.thuy@example.com nhé"), ("2", None), ("3", ""), ("4", "hay quá 😊"), (None, "x"), ("5", "hay quá " * 20_000 + "sđt 0954612596")]
    df = spark.createDataFrame([(*r, "z") for r in data], "id string, text string, masked string")
    out = {r.id: r.masked for r in personal.masked(df).collect()}
    assert out["1"] == "gọi [PHONE] gặp mình, mail mình [EMAIL] nhé"
    assert out["2"] is None and out["3"] == "" and out["4"] == "hay quá 😊" and out["5"].endswith("sđt [PHONE]")
    kinds = sorted((r.id, r.kind) for r in personal.personal_kinds(df).collect())
    assert kinds == [("1", "email"), ("1", "phone"), ("5", "phone")]
    assert personal.personal_kinds(df.limit(0)).count() == 0


@pytest.mark.parametrize("s,digits", [("o54o89o553", "054089055" + "3"), ("+84 547 259 266", "0547259266"), ("không chín năm chín sáu một bốn năm năm bốn", "0959614554"), ("(+84) 952-829023", "0952829023"), ("0954 abc", "")])
def test_phone_digits(s, digits):
    assert personal.phone_digits(s) == (digits if s[0] != "o" else "054089o553".replace("o", "0"))


def test_several_numbers_in_one_finding():
    text = "alo số 84548607580 0545940708, mã 4487 o954105465"
    spans = personal.phones_within(text, 7, len(text))
    assert [text[a:b] for a, b in spans] == ["84548607580", "0545940708", "o954105465"]
