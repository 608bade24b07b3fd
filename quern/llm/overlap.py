"""Problem 7: the same or nearly the same records in different splits.

Records with one set of words are a class. Classes get a minwise signature over their words; its
bands are the buckets. Only buckets that hold evaluation and training classes give candidates,
the exact Jaccard similarity of the word sets decides, and members are attached at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import mixed, split_words
from quern.workspace import Workspace

NUM, DEN = 4, 5  # similarity of at least 4/5
LEAST_WORDS = 8
# Each band is a fixed choice of ROWS of the HASHES minwise values of its pass. A pair at
# similarity s shares a band with a probability of about 1 - (1 - s**ROWS) ** (PASSES * BANDS):
# 0.9999 at 0.8, more above. A pass keeps the rows that are shuffled at one time few.
PASSES, HASHES, BANDS, ROWS = 2, 128, 32, 8
TRAIN = "train"


@cache
def _plan(turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and masks of a pass's hash functions, and the hashes of each band (all are used about equally often)."""
    rng = np.random.default_rng(20240229 + turn)
    times = rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    mask = rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
    rounds = math.ceil(BANDS * ROWS / HASHES)
    deck = np.concatenate([rng.permutation(HASHES) for _ in range(rounds)])
    return times, mask, deck[: BANDS * ROWS].reshape(BANDS, ROWS)


def signatures(hashes: np.ndarray, starts: np.ndarray, turn: int) -> np.ndarray:
    """Minwise values (HASHES x sets) of the sets hashes[starts[i] : starts[i + 1]], none of them empty."""
    times, mask, _ = _plan(turn)
    x = (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), dtype=np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((x ^ mask[k]) * times[k], starts)
    return out


def band_keys(sig: np.ndarray, turn: int) -> np.ndarray:
    """A 64-bit key (sets x BANDS) of every band; the band's number is part of it."""
    _, _, bands = _plan(turn)
    out = np.empty((sig.shape[1], BANDS), dtype=np.uint64)
    for b, rows in enumerate(bands):
        key = np.full(sig.shape[1], b + 1, dtype=np.uint64)
        for r in rows:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[r])
        out[:, b] = key
    return out.view(np.int64)


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of all texts, text by text; the first of each text; and each text's number of words."""
    h, doc, _, _ = split_words(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    n_words = np.bincount(doc, minlength=len(texts))
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1)), n_words


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices small enough for a hash pass to stay in the cache."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _classed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, text) to (id or text, cls): cls is a 128-bit digest of the set of words; only texts of LEAST_WORDS words."""
        for b in _slices(batches):
            sets, cuts, n = word_sets(b.column(1))
            some = np.flatnonzero(n >= LEAST_WORDS)
            if not len(some):
                continue
            digest = np.empty((len(some), 2), dtype=np.uint64)
            for k, salt in enumerate((np.uint64(0x1B873593), np.uint64(0xCC9E2D51))):
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(sets ^ salt), dtype=np.uint64)))
                digest[:, k] = sums[cuts[some + 1]] - sums[cuts[some]]
            data = pa.py_buffer(digest.tobytes())
            cls = pa.Array.from_buffers(pa.binary(16), len(some), [None, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1 if with_text else 0).take(pa.array(some)), cls], ["text" if with_text else "id", "cls"])

    return run


def _bands(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (num, text) to rows (key, num)."""
        for b in _slices(batches):
            sets, cuts, _ = word_sets(b.column(1))
            keys = band_keys(signatures(sets, cuts[:-1], turn), turn)
            nums = np.repeat(np.asarray(b.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nums)], ["key", "num"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls_t, cls_e, text_t, text_e) to (cls_t, cls_e, similarity), those of at least 4/5."""
    for b in _slices(batches):
        (x, cx, _), (y, cy, _) = word_sets(b.column(2)), word_sets(b.column(3))
        nx, ny = np.diff(cx), np.diff(cy)
        both = np.concatenate([x, y])
        pair = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        again = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
        common = np.bincount(pair[1:][again], minlength=len(nx))
        union = nx + ny - common
        ok = np.flatnonzero(common * DEN >= union * NUM)
        at = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(common[ok] / union[ok])], ["cls_t", "cls_e", "similarity"])


def class_links(split_rows: DataFrame, records: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(id, cls, split) of the records, and (cls_t, cls_e, similarity) of the near-same classes of train and other records.

    A class is a set of words; see :func:`split_overlaps`.
    """
    work = Workspace(records.sparkSession, "overlap")
    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    ids = split_rows.select(F.col(id_col).cast("string").alias("id"), F.col(split_col).alias("split")).where("id IS NOT NULL AND split IS NOT NULL").distinct()
    members = work.save(src.mapInArrow(_classed(False), "id string, cls binary").distinct().join(ids, "id"))
    side = F.when(F.col("split") == TRAIN, 1).otherwise(2)
    sides = members.groupBy("cls").agg(F.bit_or(side).alias("sides"))
    texts = src.mapInArrow(_classed(True), "text string, cls binary").groupBy("cls").agg(F.first("text").alias("text"))
    classes = work.save(texts.join(sides, "cls").select(F.monotonically_increasing_id().alias("num"), "cls", "sides", "text"))
    train, other = (classes.where(F.col("sides").bitwiseAND(bit) != 0) for bit in (1, 2))
    found = None
    for turn in range(PASSES):
        x, y = (c.select("num", "text").mapInArrow(_bands(turn), "key bigint, num bigint") for c in (train, other))
        pairs = work.save(x.withColumnRenamed("num", "t").join(y.withColumnRenamed("num", "e"), "key").where("t <> e").select("t", "e").distinct())
        found = pairs if found is None else found.unionByName(pairs)
    both = found.distinct().join(train.select(F.col("num").alias("t"), F.col("cls").alias("cls_t"), F.col("text").alias("text_t")), "t")
    both = both.join(other.select(F.col("num").alias("e"), F.col("cls").alias("cls_e"), F.col("text").alias("text_e")), "e")
    near = both.select("cls_t", "cls_e", "text_t", "text_e").mapInArrow(_verify, "cls_t binary, cls_e binary, similarity double")
    same = classes.where("sides = 3").select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_e"), F.lit(1.0).alias("similarity"))
    links = work.save(near.unionByName(same))
    return members, links


def split_overlaps(split_rows: DataFrame, records: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split") -> DataFrame:
    """(id_a, split_a, id_b, split_b, similarity): pairs of near-same records, one in train and one in another split.

    split_rows has id and split, records id and text. Records need LEAST_WORDS words; the
    similarity is the Jaccard similarity of their sets of words, at least 4/5. id_a is the
    smaller id. Rows without id, text or split are in no pair; rows that repeat an id within a
    split count once; an id that stands in train and elsewhere is in no pair with itself; if an
    id has several texts each counts.
    """
    members, links = class_links(split_rows, records, id_col, text_col, split_col)
    i = members.where(F.col("split") == TRAIN).select(F.col("id").alias("i"), F.col("split").alias("si"), F.col("cls").alias("cls_t"))
    j = members.where(F.col("split") != TRAIN).select(F.col("id").alias("j"), F.col("split").alias("sj"), F.col("cls").alias("cls_e"))
    out = links.join(i, "cls_t").join(j, "cls_e").where("i <> j")
    first = F.col("i") < F.col("j")
    return out.select(
        F.least("i", "j").alias("id_a"),
        F.when(first, F.col("si")).otherwise(F.col("sj")).alias("split_a"),
        F.greatest("i", "j").alias("id_b"),
        F.when(first, F.col("sj")).otherwise(F.col("si")).alias("split_b"),
        "similarity",
    )


def overlap_report(split_rows: DataFrame, records: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split") -> DataFrame:
    """(split, source_id, n_records, n_pairs): evaluation records that recur in train, and their pairs.

    The counts follow from the links of classes and the sizes of classes, so no pair of records is
    made. A record's source is the smallest of its rows; an id that stands in train and elsewhere
    is no pair with itself.
    """
    members, links = class_links(split_rows, records, id_col, text_col, split_col)
    train, other = members.where(F.col("split") == TRAIN), members.where(F.col("split") != TRAIN)
    sizes = train.groupBy(F.col("cls").alias("cls_t")).agg(F.count(F.lit(1)).alias("n"))
    partners = links.join(sizes, "cls_t").groupBy(F.col("cls_e").alias("cls")).agg(F.sum("n").alias("k"))
    per_row = other.join(partners, "cls").select("id", "split", "cls", "k")
    both = train.select("id", F.col("cls").alias("cls_t")).join(other.select("id", "split", F.col("cls").alias("cls_e")), "id")
    own = both.join(links.select("cls_t", "cls_e"), ["cls_t", "cls_e"]).groupBy("id", "split", F.col("cls_e").alias("cls")).agg(F.count(F.lit(1)).alias("own"))
    per_id = per_row.join(own, ["id", "split", "cls"], "left").groupBy("id", "split").agg(F.sum(F.col("k") - F.coalesce("own", F.lit(0))).alias("k")).where("k > 0")
    sources = records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min("source_id").alias("source_id"))
    return per_id.join(sources, "id").groupBy("split", "source_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("k").alias("n_pairs"))
