"""Incremental import of exports: rejects, duplicates and accepted records, in batch and as a stream.

A record is judged in the order (file, row). It is rejected if a field is missing or an id has
white space at its ends; else, if its id was accepted before, it is a duplicate (same post and
text) or rejected (other content); else, if its text key was accepted before, it is a duplicate;
else it is accepted. Only accepted records count as seen, so a later row of a duplicate's id is
judged afresh.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import py_strip, text_key
from quern.workspace import Workspace

ACCEPTED, DUPLICATE, REJECTED = "accepted", "duplicate", "rejected"
MISSING, EDGE_SPACE, CONFLICT = "missing_field", "edge_space", "conflicting_id"


def _accepted(work: Workspace, nodes: DataFrame, store: DataFrame | None) -> DataFrame:
    """(s, id, k, content) of the records that are accepted, those of the store included; no id and no key comes twice.

    nodes is (s, id, k, content), one row for each id and key, s the place of the first row. A
    node is accepted if no accepted node before it has its id or its key. In every round the nodes
    that are the first ones of both their id and their key are accepted, and all that share either
    with them are out. So a key that is shared by a third of all ids is settled in one round; the
    rounds are as many as the longest chain of nodes that take turns in sharing id and key.
    """
    found = []
    if store is not None:
        found.append(store)
        nodes = _without(nodes, store)
    nodes, left = work.save_counted(nodes)
    while left["n"]:
        by_id = nodes.groupBy("id").agg(F.min("s").alias("s"))
        by_key = nodes.groupBy("k").agg(F.min("s").alias("s"))
        won = work.save(nodes.join(by_id, ["id", "s"], "left_semi").join(by_key, ["k", "s"], "left_semi").select("s", "id", "k", "content"))
        found.append(won)
        rest, left = work.save_counted(_without(nodes, won))
        work.drop(nodes)
        nodes = rest
    out = nodes.select("s", "id", "k", "content")
    for f in found:
        out = out.unionByName(f)
    return out


def _without(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    return nodes.join(taken.select("id"), "id", "left_anti").join(taken.select("k"), "k", "left_anti").select("s", "id", "k", "content")


def judge(rows: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The rows (seq, id, post_id, text, ...) with ``state`` and ``reason``.

    store holds the records (id, post_id, text) accepted earlier. Of rows with one id and key only
    the first can be accepted, so the rows are first combined by both. No group of rows is ever
    gathered: all steps are aggregations and joins, see :func:`_accepted`. NULL counts as missing;
    seq must be unique; an empty table gives an empty one.
    """
    work = Workspace(rows.sparkSession, "ingest")
    cols = {c: F.coalesce(F.col(c), F.lit("")) for c in ("id", "post_id", "text")}
    src = rows.withColumns(cols)
    invalid = F.col("_invalid") if "_invalid" in rows.columns else F.lit(False)
    blank = (py_strip(F.col("id")) == "") | (py_strip(F.col("post_id")) == "") | (py_strip(F.col("text")) == "")
    edge = (py_strip(F.col("id")) != F.col("id")) | (py_strip(F.col("post_id")) != F.col("post_id"))
    checks = F.when(invalid | blank, MISSING).when(edge, EDGE_SPACE)
    content = F.sha2(F.concat_ws("\x01", "post_id", "text"), 256)
    src = work.save(src.withColumns({"_seq": F.col("seq").cast("bigint"), "_reason": checks, "_k": F.sha2(text_key(F.col("text")), 256), "_c": content}))
    first = F.min(F.struct(F.col("_seq").alias("s"), F.col("_c").alias("content"))).alias("f")
    nodes = src.where("_reason IS NULL").groupBy("id", F.col("_k").alias("k")).agg(first).select("f.s", "id", "k", "f.content")
    had = None
    if store is not None:
        had = work.save(store.select(F.lit(-1).cast("bigint").alias("s"), "id", F.sha2(text_key(F.col("text")), 256).alias("k"), content.alias("content")))
    taken = work.save(_accepted(work, nodes, had))
    by_id = taken.groupBy("id").agg(F.min(F.struct("s", "content")).alias("_own"))
    by_key = taken.groupBy(F.col("k").alias("_k")).agg(F.min("s").alias("_first"))
    out = src.join(by_id, "id", "left").join(by_key, "_k", "left")
    before = F.col("_own.s") < F.col("_seq")
    state = (
        F.when(F.col("_reason").isNotNull(), REJECTED)
        .when(F.col("_own.s") == F.col("_seq"), ACCEPTED)
        .when(before & (F.col("_own.content") != F.col("_c")), REJECTED)
        .otherwise(DUPLICATE)
    )
    reason = F.coalesce("_reason", F.when(before & (F.col("_own.content") != F.col("_c")), CONFLICT))
    return out.withColumns({"state": state, "reason": reason}).select(*[c for c in rows.columns if c not in ("state", "reason", "_invalid")], "state", "reason")


def up_to_target(judged: DataFrame, target: int, have: int = 0) -> DataFrame:
    """The judged rows before the store is full: rows that come after the record that fills it are left out.

    The place of that record is found from the counts of accepted records per range of seq.
    """
    from quern.operators.prefix import running_sum

    accepted = F.when(F.col("state") == ACCEPTED, 1).otherwise(0)
    seen = running_sum(judged, [], ["seq"], F.floor(F.col("seq") / 50_000), accepted, "_before")
    return seen.where(F.col("_before") + have < target).drop("_before")


def after_checkpoint(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The rows (file_key, row_number, sha256, ...) that come after each file's checkpoint (file_key, sha256, row_offset).

    A file whose hash differs from that of its checkpoint was changed, which is an error.
    """
    marks = checkpoints.select("file_key", F.col("sha256").alias("_sha"), "row_offset")
    changed = rows.select("file_key", "sha256").distinct().join(marks, "file_key").where("sha256 <> _sha")
    if bad := changed.select("file_key").limit(5).collect():
        raise ValueError(f"changed after they were imported: {[r[0] for r in bad]}")
    joined = rows.join(marks, "file_key", "left").where(F.col("row_number") > F.coalesce("row_offset", F.lit(0)))
    return joined.drop("_sha", "row_offset")


def next_checkpoints(checkpoints: DataFrame, imported: DataFrame) -> DataFrame:
    """The checkpoints after the import of rows (file_key, sha256, row_number)."""
    new = imported.groupBy("file_key", "sha256").agg(F.max("row_number").alias("row_offset"))
    both = checkpoints.select("file_key", "sha256", "row_offset").unionByName(new)
    return both.groupBy("file_key", "sha256").agg(F.max("row_offset").alias("row_offset"))


def import_batch(spark: SparkSession, rows: DataFrame, folder: str, batch: str, target: int | None = None) -> dict[str, int]:
    """Judges rows against the store in ``folder`` and appends the accepted, duplicate and rejected ones under the batch's name.

    A batch that was imported before is overwritten by the same rows, so a retry repeats nothing.
    With a target, rows after the one that fills the store are left out.
    """
    from quern.sources.tables import exists

    store = None
    if exists(spark, f"{folder}/comments"):
        store = spark.read.parquet(f"{folder}/comments").where(F.col("batch") != batch)
    work = Workspace(spark, "import")
    judged = judge(rows, store)
    if target is not None:
        judged = up_to_target(work.save(judged), target, store.count() if store is not None else 0)
    judged = work.save(judged)
    counts = {}
    for name, state in (("comments", ACCEPTED), ("duplicates", DUPLICATE), ("rejected", REJECTED)):
        part = judged.where(F.col("state") == state)
        part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        counts[name] = part.count()
    return counts


def collect_sources(spark: SparkSession, sources: Sequence[dict], folder: str, target: int | None = None) -> dict:
    """Imports the exports of several sources into the store in ``folder``; gives a report.

    A source is {source_id, source_url, permission_note, columns, exports: [{path, sha256}]}; all
    but columns (wanted -> source name) and sha256 must be there. A file whose hash is not the
    pinned one is refused. An error of one source leaves the others alone: it is in the report,
    under its source, and ``failed`` counts them; see :func:`raise_failed`. With a target, rows
    after the one that fills the store are left out.
    """
    from quern.sources import tables

    report: dict = {"sources": {}, "failed": 0}
    for n, source in enumerate(sources):
        name = str(source.get("source_id") or f"source {n + 1}")
        try:
            if lacking := [k for k in ("source_id", "source_url", "permission_note", "exports") if not source.get(k)]:
                raise ValueError(f"the source has no {', '.join(lacking)}")
            counts = dict.fromkeys(("comments", "duplicates", "rejected"), 0)
            for k, export in enumerate(source["exports"]):
                digest = tables.file_hashes(spark, export["path"]).first()["sha256"]
                if export.get("sha256") not in (None, digest):
                    raise ValueError(f"{export['path']} is not the file that was pinned")
                mapping = {c: c for c in ("id", "post_id", "text")} | source.get("columns", {})
                rows = tables.map_columns(tables.read_export(spark, export["path"], sorted(set(mapping.values()))), mapping)
                rows = tables.with_row_number(rows.withColumn("_place", F.monotonically_increasing_id()), ["_place"]).drop("_place")
                rows = rows.withColumns({"source_id": F.lit(name), "source_url": F.lit(source["source_url"]), "file_sha256": F.lit(digest)})
                done = import_batch(spark, rows, folder, f"{n:03d}-{k:03d}-{digest[:12]}", target)
                counts = {c: counts[c] + done[c] for c in counts}
            report["sources"][name] = counts
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            report["sources"][name] = {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
            report["failed"] += 1
    if tables.exists(spark, f"{folder}/comments"):
        kept = spark.read.parquet(f"{folder}/comments")
        report |= {"valid_unique_ids": kept.count(), "posts": kept.select("post_id").distinct().count(), "target_reached": target is not None and kept.count() >= target}
    return report


def raise_failed(report: dict) -> dict:
    """The report itself; a ValueError if a source failed."""
    if report["failed"]:
        raise ValueError("; ".join(f"{k}: {v['error']}" for k, v in report["sources"].items() if "error" in v))
    return report


def snapshot(spark: SparkSession, folder: str, path: str) -> int:
    """Writes the accepted records in the order of their ids as CSV, by way of a folder that is renamed when it is complete; the number of rows."""
    from quern.sources import tables

    rows = spark.read.parquet(f"{folder}/comments")
    columns = [c for c in ("id", "post_id", "text", "source_id", "source_url", "collected_at") if c in rows.columns]
    tables.replace_with(spark, path, lambda to: tables.write_csv(rows.select(*columns).orderBy("id"), to))
    return rows.count()


def stream_exports(spark: SparkSession, source: str, schema, folder: str, checkpoint: str, files_per_batch: int = 16):
    """A file stream that imports every new export file once; progress is in ``checkpoint``, changed files are not read again.

    Rows come with ``file_key`` and are judged in the order of file and row place. Returns the
    query, triggered for what is there.
    """
    from quern.sources.tables import with_row_number

    def each(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        numbered = with_row_number(df, ["file_key", "row_number"])
        import_batch(df.sparkSession, numbered, folder, f"{epoch:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
