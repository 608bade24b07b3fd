"""Problem 9: a mix of sources with target shares of all tokens.

Each source's documents are shuffled by a hash, repeated as often as needed (but no more than
allowed) and cut into blocks of equally many tokens. Golden-ratio points, mapped through the
cumulative numbers of blocks, give every slot of the mix a source; the k-th slot of a source
takes its k-th block. So every stretch of the mix has nearly the target shares. There are as many
points as blocks and every point is hit once (i -> i * g mod n, g the number next to n / golden
ratio that shares no factor with n), so each block of each source has its slot.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.words import strip
from quern.operators.prefix import running_sum
from quern.workspace import Workspace, maybe_broadcast

# Fixed value: the pre-tokenization pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 8192
GOLDEN = (math.sqrt(5) - 1) / 2
ROWS_PER_PART = 50_000
MOST_SOURCES = 100_000
_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, made once per process."""
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", *, vocabulary: str) -> DataFrame:
    """The columns ``keep`` and n_tokens; a NULL text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    src = docs.select(*keep, F.col(text_col).alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}, n_tokens bigint")


def source_key(c: Column) -> Column:
    """A source's name without white space at the ends, in lower case, with - for _."""
    return F.translate(F.lower(strip(c)), "_", "-")


def _quotas(work: Workspace, counted: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Per target source: tokens at hand, quota, and the passes over its documents; and the total of all tokens.

    The quota is the target share of the tokens of all documents, but no more than max_repeats
    passes give.
    """
    at_hand = work.save(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    total = at_hand.agg(F.sum("tokens")).first()[0] or 0
    t = targets.where("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    q = t.join(at_hand, "source", "left").na.fill(0, ["tokens", "n_docs"])
    wanted = F.round(F.col("target_share") * F.lit(total)).cast("bigint")
    q = q.withColumn("wanted", wanted).withColumn("quota", F.least("wanted", F.col("tokens") * F.col("max_repeats")))
    return work.save(q.withColumn("passes", F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(0).cast("int"))), total


def golden_step(n: int) -> int:
    """The number next to n times the golden ratio that shares no factor with n."""
    near = round(n * GOLDEN)
    return next(g for d in range(n + 1) for g in (near - d, near + d) if g > 0 and math.gcd(g, n) == 1)


def golden_points(slots: np.ndarray, n: int, step: int) -> np.ndarray:
    """slot * step mod n, in pieces of 20 bits so that products of numbers below 2**42 don't overflow."""
    out = np.zeros(len(slots), dtype=np.int64)
    for shift in (40, 20, 0):
        out = ((out << 20) + ((slots >> shift) & 0xFFFFF) * step) % n
    return out


def _slots(sizes: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, slot): the slots of each source in order, as many as it has blocks.

    sizes is (source, taken_tokens); sources are few, and their bound is checked.
    """
    spark = sizes.sparkSession
    blocks = F.ceil(F.col("taken_tokens") / block_tokens).cast("bigint")
    shares = sizes.where("taken_tokens > 0").select("source", blocks.alias("n")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(shares) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not shares:
        return spark.createDataFrame([], "source string, block bigint, slot bigint")
    edges = np.cumsum([r["n"] for r in shares], dtype=np.int64)
    names, n = np.asarray([r["source"] for r in shares], dtype=object), int(edges[-1])
    step = golden_step(n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.asarray(b.column(0))
            at = np.searchsorted(edges, golden_points(slot, n, step), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.string()), pa.array(slot)], ["source", "slot"])

    placed = spark.range(n).mapInArrow(place, "source string, slot bigint")
    return running_sum(placed, ["source"], ["slot"], F.floor(F.col("slot") / ROWS_PER_PART), F.lit(1), "block")


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0, doc_id: str = "doc_id", *, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares).

    The mix: (slot, place, source, doc_id, repeat, from_token, n_tokens), one row for each piece
    of a document in a block, to be read in the order of slot and place; place is the piece's
    first token in its source's stream, from_token its first token in the document. All blocks of
    a source but the last hold block_tokens tokens; a document that crosses the end of a block
    goes on in the source's next one. Shares: (source, target_share, max_repeats, tokens,
    taken_docs, taken_tokens, actual_share, share_of_all, short). A source takes whole documents
    and stops at the one nearest to its quota, so it misses it by half a document at most; one
    that is too small even with max_repeats passes stays below it and is marked short. Documents
    of other or no sources and without tokens are in no slot. Documents with one id are taken as
    they come; empty tables give an empty mix.
    ``vocabulary`` is a tiktoken file that every executor can read.
    """
    work = Workspace(docs.sparkSession, "mix")
    src = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("text"))
    counted = work.save(token_counts(src, ["doc_id", "source"], vocabulary=vocabulary))
    quotas, total = _quotas(work, counted, targets)
    small = maybe_broadcast(quotas.select("source", "quota", "passes", "n_docs"))
    taken = counted.where("n_tokens > 0").join(small, "source").where("passes > 0").select("source", "doc_id", "n_tokens", "quota", "n_docs", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat"))
    # the order within a pass: by hash; the parts of a pass are ranges of the hash
    taken = taken.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "repeat", F.lit(seed)), 1))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_PART))
    part = F.col("repeat") * parts + F.floor(F.col("h").cast("double") / float(1 << 63) * parts)
    streams = running_sum(taken, ["source"], ["repeat", "h", "doc_id"], part.cast("bigint"), F.col("n_tokens"), "start")
    # up to the document whose middle lies within the quota
    chosen = work.save(streams.where("2 * start + n_tokens <= 2 * quota").select("source", "doc_id", "repeat", "n_tokens", "start"))
    sums = work.save(chosen.groupBy("source").agg(F.count(F.lit(1)).alias("taken_docs"), F.sum("n_tokens").alias("taken_tokens")))
    slots = _slots(sums, block_tokens)
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("n_tokens") - 1) / block_tokens)
    pieces = chosen.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("start", F.col("block") * block_tokens)
    end = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    pieces = pieces.select("source", "block", begin.alias("place"), "doc_id", "repeat", (begin - F.col("start")).alias("from_token"), (end - begin).alias("n_tokens"))
    mixed = pieces.join(slots, ["source", "block"]).select("slot", "place", "source", "doc_id", "repeat", "from_token", "n_tokens")
    all_taken = sums.agg(F.sum("taken_tokens")).first()[0] or 0
    shares = quotas.join(sums, "source", "left").na.fill(0, ["taken_docs", "taken_tokens"])
    shares = shares.select(
        "source", "target_share", "max_repeats", "tokens", "taken_docs", "taken_tokens",
        (F.col("taken_tokens") / F.lit(max(all_taken, 1))).alias("actual_share"),
        (F.col("taken_tokens") / F.lit(max(total, 1))).alias("share_of_all"),
        (F.col("quota") < F.col("wanted")).alias("short"),
    )
    return mixed, shares


def broken_rules(mixed: DataFrame, shares: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(rule, n_broken): in how many cases a mix breaks its rules; all 0 for a right mix.

    shared_slot: slots of two sources; missing_slot: slots below the last one that are empty;
    uneven_block: blocks other than a source's last that don't hold block_tokens tokens; gap:
    sources whose pieces don't add up to their stream; taken_too_often: documents taken more than
    max_repeats times; over_share: sources that miss their share without being short by more than
    their longest taken document.
    """
    slots = mixed.groupBy("slot").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.sum("n_tokens").alias("n"), F.max(F.col("place") + F.col("n_tokens")).alias("end"))
    streams = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max(F.col("place") + F.col("n_tokens")).alias("end"))
    ends = streams.select(F.col("source").alias("a"), F.col("end").alias("last"))
    taken = mixed.groupBy("source", "doc_id").agg(F.countDistinct("repeat").alias("times"))
    longest = mixed.groupBy("source", "doc_id", "repeat").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.max("n").alias("longest"))
    most = shares.select("source", "max_repeats")
    off = F.abs(F.col("share_of_all") - F.col("target_share")) * F.col("taken_tokens") / F.col("share_of_all")
    rules = [
        slots.where("a <> b").select(F.lit("shared_slot").alias("rule")),
        slots.agg((F.coalesce(F.max("slot") + 1, F.lit(0)) - F.count(F.lit(1))).alias("n")).where("n > 0").select(F.lit("missing_slot").alias("rule")),
        slots.join(ends, "a").where((F.col("n") != block_tokens) & (F.col("end") != F.col("last"))).select(F.lit("uneven_block").alias("rule")),
        streams.where("n <> end").select(F.lit("gap").alias("rule")),
        taken.join(most, "source").where("times > max_repeats").select(F.lit("taken_too_often").alias("rule")),
        shares.join(longest, "source").where(~F.col("short") & (off > F.col("longest"))).select(F.lit("over_share").alias("rule")),
    ]
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    names = mixed.sparkSession.createDataFrame([(x,) for x in ("shared_slot", "missing_slot", "uneven_block", "gap", "taken_too_often", "over_share")], "rule string")
    return names.join(found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken")), "rule", "left").na.fill(0, ["n_broken"])
