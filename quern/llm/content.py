"""Problem 1: records whose content differs only in white space, case, punctuation or entry order.

Canonical keys are range-partitioned and sorted; each partition is scanned once, comparing
neighbouring full keys. Rows of one key may lie in several partitions: the sort key ends in the
record id and a spread column, and runs that touch a partition's border are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.words import strip, words
from quern.workspace import Workspace

LEAST_ENTRIES = 3
ENTRY_BREAK = r"[;\n\r\x{0B}\f\x{85}\x{2028}\x{2029}]"
WORDS_KEY, ENTRIES_KEY = 1, 2


def entries_key(text: Column) -> Column:
    """The sorted entries of a form text (three or more `name: value`), each by its words; NULL for other texts."""
    entries = F.filter(F.split(F.coalesce(text, F.lit("")), ENTRY_BREAK), lambda e: strip(e) != "")
    is_form = (F.size(entries) >= LEAST_ENTRIES) & F.forall(entries, lambda e: e.rlike(r"^[\p{IsWhite_Space}]*[^:\p{IsWhite_Space}][^:]*:"))
    ordered = F.array_sort(F.transform(entries, lambda e: F.array_join(words(e), " ")))
    return F.when(is_form, F.array_join(ordered, "\n"))


_SCAN = pa.schema(
    [("kind", pa.int8()), ("id", pa.string()), ("n_rows", pa.int64()), ("n_words", pa.int32()), ("first_id", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("border_key", pa.string())]
)
_SCAN_DDL = "kind tinyint, id string, n_rows bigint, n_words int, first_id string, part int, run bigint, border_key string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (kind, key) and id; the first and the last run of the partition carry their key."""
    part = TaskContext.get().partitionId()
    last = None  # the open group: kind, key, id, rows, words, first id of its run, run
    held: list[tuple] = []

    def emit(groups: list[tuple], border: bool) -> pa.RecordBatch:
        cols = list(zip(*[(k, i, n, w, f, part, r, key if border else None) for k, key, i, n, w, f, r in groups]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCAN.types)], schema=_SCAN)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kind, key, ident, count, n_words = (b.column(i) for i in range(5))
        new_run, new_id = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        if n > 1:
            kinds = kind.to_numpy(zero_copy_only=False)
            new_run[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (kinds[1:] != kinds[:-1])
            new_id[1:] = new_run[1:] | pc.not_equal(ident[1:], ident[:-1]).to_numpy(zero_copy_only=False)
        run0 = last[6] if last else -1
        if last and last[0] == kind[0].as_py() and last[1] == key[0].as_py():
            new_run[0] = False
            new_id[0] = last[2] != ident[0].as_py()
        runs = run0 + np.cumsum(new_run)
        starts = np.flatnonzero(new_id)
        counts = count.to_numpy(zero_copy_only=False)
        if len(starts) == 0 or starts[0] > 0:
            stop = starts[0] if len(starts) else n
            last = (*last[:3], last[3] + int(counts[:stop].sum()), *last[4:])
        if not len(starts):
            continue
        sums = np.add.reduceat(counts, starts)
        heads = starts[np.maximum(np.searchsorted(starts, np.flatnonzero(new_run), side="left"), 0)] if new_run.any() else np.zeros(0, dtype=np.int64)
        head_of = np.searchsorted(heads, starts, side="right") - 1
        first = ident.take(pa.array(heads[np.maximum(head_of, 0)])) if len(heads) else pa.nulls(len(starts), pa.string())
        if (head_of < 0).any():
            first = pc.if_else(pa.array(head_of < 0), pa.scalar(last[5]), first)
        # the group open before this batch is complete now; the batch's last group stays open
        if last:
            held.append(last)
        take = starts[:-1]
        out = pa.RecordBatch.from_arrays(
            [kind.take(pa.array(take)).cast(pa.int8()), ident.take(pa.array(take)), pa.array(sums[:-1]), n_words.take(pa.array(take)), first[: len(take)], pa.array(np.full(len(take), part, np.int32)), pa.array(runs[take]), pa.nulls(len(take), pa.string())],
            schema=_SCAN,
        )
        if held:
            yield emit(held, held[0][6] == 0)
            held = []
        if out.num_rows:
            of_first = pc.equal(out.column(6), 0)
            if pc.any(of_first).as_py():
                keys = pc.if_else(of_first, key.take(pa.array(take)), pa.scalar(None, pa.string()))
                out = out.set_column(7, "border_key", keys)
            yield out
        s = starts[-1]
        last = (kind[s].as_py(), key[s].as_py(), ident[s].as_py(), int(sums[-1]), n_words[s].as_py(), first[len(starts) - 1].as_py(), int(runs[s]))
    if last:
        yield emit([last], True)


def content_classes(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(canonical_id, comment_id, n_rows, n_words): the content class of every record id.

    canonical_id is the smallest id with the same content, n_rows the rows delivered under the
    id. Rows without an id are left out; a NULL text is the empty text, and all wordless texts
    are one class; rows with one id are one record (of differing texts the smallest class
    counts). Word sequences and form entries are two keys of a record; classes that share a
    record are one.
    """
    work = Workspace(records.sparkSession, "content")
    src = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    keyed = src.select("id", words(F.col("text")).alias("ws"), entries_key(F.col("text")).alias("entries"))
    both = F.array(
        F.struct(F.lit(WORDS_KEY).alias("kind"), F.array_join("ws", " ").alias("key")),
        F.struct(F.lit(ENTRIES_KEY).alias("kind"), F.col("entries").alias("key")),
    )
    rows = keyed.select("id", F.size("ws").alias("n_words"), F.explode(both).alias("k")).where("k.key IS NOT NULL")
    rows = rows.select("k.kind", "k.key", "id", F.lit(1).cast("bigint").alias("n"), "n_words", F.monotonically_increasing_id().alias("spread"))
    rows = work.save(rows)  # the ranges are sampled from the keys first, so these are read twice
    ordered = rows.repartitionByRange("kind", "key", "id", "spread").sortWithinPartitions("kind", "key", "id")
    scanned = work.save(ordered.drop("spread").mapInArrow(_scan, _SCAN_DDL))
    work.drop(rows)

    # runs of one key in several partitions: at most two of each partition have a key to compare
    border = scanned.where("border_key IS NOT NULL").groupBy("kind", "border_key", "part", "run").agg(F.min("first_id").alias("f"))
    true_first = border.groupBy("kind", "border_key").agg(F.min("f").alias("true_first"), F.collect_set(F.struct("part", "run")).alias("at"), F.count(F.lit(1)).alias("n"))
    moved = true_first.where("n > 1").select("true_first", F.explode("at").alias("at")).select("true_first", "at.part", "at.run")
    classes = (
        scanned.drop("border_key")
        .join(F.broadcast(moved), ["part", "run"], "left")  # at most two rows for each partition
        .select("kind", "id", "n_rows", "n_words", F.coalesce("true_first", "first_id").alias("canon"))
    )
    per_id = classes.groupBy("id").agg(
        F.min(F.when(F.col("kind") == WORDS_KEY, F.col("canon"))).alias("by_words"),
        F.min(F.when(F.col("kind") == ENTRIES_KEY, F.col("canon"))).alias("by_entries"),
        F.sum(F.when(F.col("kind") == WORDS_KEY, F.col("n_rows"))).alias("n_rows"),
        F.max("n_words").alias("n_words"),
    )
    per_id = work.save(per_id)
    work.drop(scanned)
    labels = _joined_classes(work, per_id)
    out = per_id.join(labels, per_id.by_words == labels.node, "left")
    return out.select(F.coalesce("label", "by_words").alias("canonical_id"), F.col("id").alias("comment_id"), "n_rows", "n_words")


def _joined_classes(work: Workspace, per_id: DataFrame) -> DataFrame:
    """(node, label) of the word classes that share a form: smallest ids are passed on until none changes."""
    edges = work.save(per_id.where("by_entries IS NOT NULL AND by_entries <> by_words").select("by_words", "by_entries").distinct())
    both = edges.select(F.col("by_words").alias("a"), F.col("by_entries").alias("b"))
    both = both.unionByName(edges.select(F.col("by_entries").alias("a"), F.col("by_words").alias("b")))
    labels = work.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed"))
        new, seen = work.save_counted(stepped, changed=F.count_if("changed"))
        work.drop(labels)
        labels = new.drop("changed")
        labels._quern_path = new._quern_path
        if not seen["changed"]:
            return labels


def copies(records: DataFrame, deliveries: DataFrame, id_col: str = "id", text_col: str = "text", delivered_id: str = "comment_id") -> DataFrame:
    """(canonical_id, n_comments, n_rows, n_logged, n_copies): one row per content.

    n_comments are the ids of the content, n_rows their rows, n_logged the log rows (each
    delivery once; stray characters around the id are dropped) and n_copies rows and log rows
    together. Log rows of unknown ids count nowhere.
    """
    classes = content_classes(records, id_col, text_col)
    clean = F.regexp_replace(F.col(delivered_id), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    log = deliveries.select("file_key", "row_number", clean.alias("comment_id")).distinct()
    logged = log.groupBy("comment_id").agg(F.count(F.lit(1)).alias("n_logged"))
    per_id = classes.join(logged, "comment_id", "left")
    return per_id.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.coalesce("n_logged", F.lit(0))).alias("n_logged"),
        F.sum(F.col("n_rows") + F.coalesce("n_logged", F.lit(0))).alias("n_copies"),
    )


def same_content(records: DataFrame, least_words: int = 8, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(canonical_id, comment_id): records of at least ``least_words`` words that repeat the content of a smaller id."""
    c = content_classes(records, id_col, text_col)
    return c.where((F.col("n_words") >= least_words) & (F.col("comment_id") != F.col("canonical_id"))).select("canonical_id", "comment_id")
