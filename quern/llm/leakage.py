"""Problem 8: passages of evaluation texts inside training documents.

Each Arrow batch of documents is a shard. A shard gets a suffix array over its words (prefix
doubling in numpy), every suffix of the evaluation texts is binary-searched in it, and the hits
are extended to the longest verbatim match. Documents are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lookalike import duck, form_sql
from quern.llm.tokens import split_words
from quern.workspace import Workspace

SHARD_BYTES = 6_000_000
# Evaluation texts are sent to the tasks in blocks of at most this many characters.
BLOCK_CHARS = 16_000_000


@dataclass
class Passages:
    """The words of a block of evaluation texts, one after the other."""

    words: np.ndarray  # uint64 hashes
    item: np.ndarray  # index of the text that a word belongs to
    left: np.ndarray  # words from a position to the end of its text
    ids: np.ndarray


def passages(ids: list[int], texts: list[str]) -> Passages:
    con = duck()
    con.register("batch", pa.table({"n": pa.array(range(len(ids)), pa.int64()), "text": pa.array(texts, pa.string())}))
    forms = con.sql(f"SELECT n, {form_sql('text')} AS form FROM batch ORDER BY n").to_arrow_table()["form"].combine_chunks()
    words, doc, _, _ = split_words(forms)
    ends = np.searchsorted(doc, doc, side="right")
    return Passages(words, doc, ends - np.arange(len(doc)), np.asarray(ids, dtype=np.int64))


class SuffixArray:
    """Suffixes of a shard's words in the order of their first ``depth`` words.

    Built by prefix doubling: level k ranks the runs of 2**k words, and a run of ``depth`` words
    is ordered by the ranks of its two parts. A run never reaches past the end of its document.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, depth: int):
        self.depth = depth
        n = len(words)
        last = np.searchsorted(doc, doc, side="right") - 1
        self.left = last - np.arange(n) + 1
        self.levels: list[tuple[int, np.ndarray]] = []
        values, rank = np.unique(words, return_inverse=True)
        self.levels.append((0, values))
        rank, size = rank.astype(np.int64), 1
        self.step = []
        while size < depth:
            step = min(size, depth - size)
            # ranks of the run that starts `step` words on; 0 stands for a document's end
            nxt = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(self.left > step)
            nxt[inside] = rank[inside + step] + 1
            key = rank * np.int64(n + 1) + nxt
            self.step.append((step, n + 1))
            if size + step < depth:
                values, rank = np.unique(key, return_inverse=True)
                self.levels.append((step, values))
                rank = rank.astype(np.int64)
            else:
                self.order = np.argsort(key, kind="stable")
                self.keys = key[self.order]
            size += step

    def find(self, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix of the passages with at least ``depth`` words: its start, and the range of equal runs."""
        q = len(p.words)
        rank, ok = self._lookup(self.levels[0][1], p.words, np.ones(q, dtype=bool))
        size = 1
        for k, (step, base) in enumerate(self.step):
            nxt, there = np.zeros(q, dtype=np.int64), np.zeros(q, dtype=bool)
            inside = np.flatnonzero(p.left >= size + step)
            there[inside] = ok[inside] & ok[inside + step]
            nxt[inside] = rank[inside + step] + 1
            key = rank * np.int64(base) + nxt
            if k + 1 < len(self.step):
                rank, ok = self._lookup(self.levels[k + 1][1], key, there)
            else:
                at = np.flatnonzero(there)
                lo = np.searchsorted(self.keys, key[at], side="left")
                hi = np.searchsorted(self.keys, key[at], side="right")
                hit = hi > lo
                return at[hit], lo[hit], hi[hit]
            size += step
        raise ValueError("depth must be at least 2")

    @staticmethod
    def _lookup(values: np.ndarray, keys: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(values, keys)
        at[at == len(values)] = 0
        return at.astype(np.int64), ok & (values[at] == keys if len(values) else np.zeros(len(keys), dtype=bool))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [lo, hi) and the number of the range of each."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def search(words: np.ndarray, doc: np.ndarray, p: Passages, least: int) -> pa.Table | None:
    """Per document of the shard and evaluation text: the longest common run of at least ``least`` words."""
    if not len(words) or not len(p.words):
        return None
    sa = SuffixArray(words, doc, least)
    at, lo, hi = sa.find(p)
    if not len(at):
        return None
    pos, which = _ranges(lo, hi)
    there, here = sa.order[pos], at[which]
    # a match that can be extended to the left is part of a longer one
    back = (there > 0) & (here > 0)
    back[back] = (words[there[back] - 1] == p.words[here[back] - 1]) & (doc[there[back] - 1] == doc[there[back]]) & (p.item[here[back] - 1] == p.item[here[back]])
    there, here = there[~back], here[~back]
    length = np.full(len(there), least)
    room = np.minimum(sa.left[there], p.left[here])
    growing = np.flatnonzero(length < room)
    while len(growing):
        same = words[there[growing] + length[growing]] == p.words[here[growing] + length[growing]]
        growing = growing[same]
        length[growing] += 1
        growing = growing[length[growing] < room[growing]]
    d, i = doc[there], p.item[here]
    order = np.lexsort((here, there, -length, i, d))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(d[order]) != 0) | (np.diff(i[order]) != 0)
    best = order[first]
    starts = np.searchsorted(doc, d[best])
    item_starts = np.searchsorted(p.item, i[best])
    return pa.table({"doc": d[best].astype(np.int64), "item_id": p.ids[i[best]], "n_words": length[best].astype(np.int32), "doc_word": (there[best] - starts).astype(np.int32), "item_word": (here[best] - item_starts).astype(np.int32)})


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about SHARD_BYTES of text; a longer text is a shard of its own."""
    for b in batches:
        text = b.column(1)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SHARD_BYTES, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def leaked(docs: DataFrame, items: DataFrame, least: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): the longest run of at least ``least`` common words per pair.

    Words are compared after look-alike characters have been made equal. doc_word and item_word
    count from 0; of runs of equal length the first in the document is given. The evaluation
    table is a stated query set: it is read to the driver in blocks of at most BLOCK_CHARS
    characters (or one longer text), and each block is searched in all documents. With several
    blocks the hits of one are written before the next is read, so no more than one block is held
    at a time. NULL and short texts match nothing; a repeated id gives repeated rows; other
    columns are ignored.
    """
    items = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    src = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    work = Workspace(docs.sparkSession, "leaks")
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        rows = part.orderBy("item").collect()
        sent = docs.sparkSession.sparkContext.broadcast(passages([r[0] for r in rows], [r[1] for r in rows]))
        found = _search_block(src, sent, least)
        if blocks > 1:
            found = work.save(found)
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(doc_id), F.col("item_id").alias(item_id), "n_words", "doc_word", "item_word")


def _search_block(src: DataFrame, sent: Broadcast, least: int) -> DataFrame:
    def run(batches):
        con, block = duck(), sent.value
        for b in _shards(batches):
            if not b.num_rows:
                continue
            con.register("batch", pa.table({"n": pa.array(np.arange(b.num_rows)), "text": b.column(1)}))
            forms = con.sql(f"SELECT n, {form_sql('text')} AS form FROM batch").to_arrow_table()
            con.unregister("batch")
            row = forms["n"].to_numpy()
            words, doc, _, _ = split_words(forms["form"].combine_chunks())
            hits = search(words, doc, block, least)
            if hits is not None:
                ids = b.column(0).take(pa.array(row[hits["doc"].to_numpy()]))
                yield from hits.set_column(0, "doc", ids).to_batches()

    kind = src.schema["doc"].dataType.simpleString()
    return src.mapInArrow(run, f"doc {kind}, item_id bigint, n_words int, doc_word int, item_word int")


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no passage of an evaluation text."""
    return docs.join(found.select(doc_id).distinct(), doc_id, "left_anti")
