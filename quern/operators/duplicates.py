"""Exact and near duplicates by the characters of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import text_key
from quern.operators import set_join
from quern.workspace import Workspace

# Shortest key, least ratio of lengths, least Jaccard similarity (a fraction) and least character ratio.
LEAST_LENGTH, LEAST_LENGTH_RATIO, JACCARD_NUM, JACCARD_DEN, LEAST_RATIO = 12, 0.8, 3, 5, 0.9


def duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(group_key, n, first_id, last_id) of the texts that occur more than once; the key is a digest of the text key."""
    keyed = df.select(F.col(id_col).alias("id"), F.sha2(text_key(F.col(text_col)), 256).alias("group_key")).where("group_key IS NOT NULL")
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def first_canonical(df: DataFrame, seq: str = "seq", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, canonical_id) of every row of a repeated text; canonical is the first by ``seq``."""
    keyed = df.select(F.col(id_col).alias("id"), F.col(seq).alias("s"), F.sha2(text_key(F.col(text_col)), 256).alias("k")).where("k IS NOT NULL")
    heads = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "s").alias("canonical_id")).where("n > 1")
    return keyed.join(heads, "k").select("id", "canonical_id")


def historical_duplicates(captures: DataFrame, main: DataFrame) -> DataFrame:
    """The capture rows with ``relationship`` and canonical_id: same_id, conflicting_id, historical_content or new_content."""
    ids = main.groupBy("id").agg(F.max_by(F.xxhash64("post_id", "text"), F.struct("post_id", "text")).alias("_c"))
    keys = main.select("id", F.sha2(text_key(F.col("text")), 256).alias("_k")).groupBy("_k").agg(F.max("id").alias("_by_text"))
    rows = captures.withColumns({"_k": F.sha2(text_key(F.col("text")), 256), "_own": F.xxhash64("post_id", "text")})
    rows = rows.join(ids.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").join(keys, "_k", "left")
    rel = F.when(F.col("_id").isNotNull(), F.when(F.col("_c") == F.col("_own"), "same_id").otherwise("conflicting_id")).when(F.col("_by_text").isNotNull(), "historical_content").otherwise("new_content")
    return rows.withColumns({"relationship": rel, "canonical_id": F.coalesce("_id", "_by_text")}).drop("_k", "_own", "_id", "_c", "_by_text")


def jaccard_candidates(df: DataFrame, seq: str = "seq", id_col: str = "id", text_col: str = "text", work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, classes): texts whose token sets have a Jaccard similarity of at least 3/5 and similar lengths.

    Rows with one key are a class, of which the first by ``seq`` stands for all; keys of one class
    are never paired. The pairs come from :mod:`quern.operators.set_join`, which loses none, and
    are checked here by their tokens. Pairs (a, b) have a before b by ``seq``.
    """
    work = work or Workspace(df.sparkSession, "near")
    keyed = df.select(F.col(id_col).alias("id"), F.col(seq).alias("seq"), text_key(F.col(text_col)).alias("key")).where(F.length("key") >= LEAST_LENGTH)
    classes = keyed.groupBy(F.sha2("key", 256).alias("cls")).agg(F.min_by(F.struct("seq", "id", "key"), "seq").alias("h")).select(F.col("h.seq").alias("seq"), F.col("h.id").alias("id"), F.col("h.key").alias("key"))
    classes, seen = work.save_counted(classes.withColumn("cid", F.monotonically_increasing_id()))
    tk = F.array_distinct(F.split("key", " "))  # the key has single spaces only
    sets = classes.select("cid", F.length("key").alias("len"), F.transform(tk, lambda w: F.xxhash64(w)).alias("h"))
    pairs = work.save(set_join.candidates(sets, seen["n"]).distinct())
    left, right = (classes.select(F.col("cid").alias(f"cid_{x}"), F.col("seq").alias(x), F.col("id").alias(f"id_{x}"), F.col("key").alias(f"key_{x}")) for x in "ab")
    both = pairs.select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b")).join(left, "cid_a").join(right, "cid_b")
    ordered = F.col("a") < F.col("b")
    both = both.select(*[F.when(ordered if x == "a" else ~ordered, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(f"{c}{x}") for c in ("", "id_", "key_") for x in "ab"])
    common = F.size(F.array_intersect("tk_a", "tk_b"))
    both = both.withColumns({f"tk_{x}": F.array_distinct(F.split(f"key_{x}", " ")) for x in "ab"}).withColumn("common", common)
    near = both.where(JACCARD_DEN * F.col("common") >= JACCARD_NUM * (F.size("tk_a") + F.size("tk_b") - F.col("common")))
    near = near.where(f"least(length(key_a), length(key_b)) >= {LEAST_LENGTH_RATIO} * greatest(length(key_a), length(key_b))")
    return near.select("a", "b", "id_a", "id_b", "key_a", "key_b", (F.col("common") / (F.size("tk_a") + F.size("tk_b") - F.col("common"))).alias("jaccard")), classes


def _longest(a: str, b: str, most: int) -> tuple[int, int, int]:
    """(i, j, size) of the longest common substring, of at most ``most``, the first in a, then in b."""
    low, high, grams = 0, min(len(a), len(b), most), {""}
    while low < high:
        size = (low + high + 1) // 2
        own = {b[j : j + size] for j in range(len(b) - size + 1)}
        if not own.isdisjoint([a[i : i + size] for i in range(len(a) - size + 1)]):
            low, grams = size, own
        else:
            high = size - 1
    i = next(i for i in range(len(a) - low + 1) if a[i : i + low] in grams)
    return i, b.find(a[i : i + low]), low


def ratio(a: str, b: str, least: float) -> float:
    """The ratio of difflib's SequenceMatcher without junk; 0 if it is less than ``least``."""
    total = len(a) + len(b)
    found, rest, open_ = 0, min(len(a), len(b)), [(a, b, total)]
    while open_:
        x, y, most = open_.pop()
        rest -= min(len(x), len(y))
        i, j, size = _longest(x, y, most)
        if size:
            found += size
            for part in ((x[:i], y[:j]), (x[i + size :], y[j + size :])):
                if part[0] and part[1]:
                    open_.append((*part, size))
                    rest += min(len(part[0]), len(part[1]))
        if 2.0 * (found + rest) / total < least:  # what is open can't make up for it
            return 0.0
    return 2.0 * found / total


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = [ratio(a, b, LEAST_RATIO) for a, b in zip(p.key_a, p.key_b)]
        yield p[["id_a", "id_b"]].assign(similarity=[round(r, 5) if r >= LEAST_RATIO else float("nan") for r in out])


def near_pairs(df: DataFrame, seq: str = "seq", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, similarity): near duplicates by the ratio of matching characters, at least 0.9, rounded to 5 places.

    One row per pair of class representatives (see :func:`jaccard_candidates`; join
    :func:`first_canonical` for the members). Keys shorter than 12 characters and equal keys are
    in no pair. The ratio is taken of the earlier row and the later, as it depends on the order.
    """
    pairs, _ = jaccard_candidates(df, seq, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    spread = pairs.select("id_a", "id_b", "key_a", "key_b").repartition("id_a", "id_b")  # scoring is the costly part
    return spread.mapInPandas(_ratios, f"id_a {kind}, id_b {kind}, similarity double").where(~F.isnan("similarity"))
