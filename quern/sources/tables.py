"""File sources and sinks: strict text tables, JSON captures, decision batches, guarded writers."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A value that no cell has, so that neither '' nor NA is read as NULL.
_NO_NULL = "\x00"
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": _NO_NULL, "encoding": "UTF-8"}


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file (or of the first file of a folder); empty or repeated names are an error."""
    line = spark.read.text(path).limit(1).collect()
    header = next(csv.reader(io.StringIO(line[0][0].lstrip("﻿")))) if line else []
    if not header or any(not h.strip() for h in header) or len(set(header)) != len(header):
        raise ValueError(f"{path}: the header is missing, has empty or repeated names")
    return header


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV file with all columns as strings as they stand: no types, no NULLs, leading zeros kept, a BOM dropped.

    Line breaks and doubled quotes in quoted fields are data. Rows with another number of fields
    than the header are an error, raised when they are read.
    """
    header = csv_header(spark, path)
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.options(**CSV_OPTIONS, mode="FAILFAST", enforceSchema=False).schema(schema).csv(path)


def read_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of an export by its suffix: .csv, .jsonl, or .json with a list or {"data": [...]}; any other is an error.

    The columns are strings; what is no string in JSON comes as NULL, with ``_invalid`` set.
    """
    low = path.lower().rstrip("/*")
    if low.endswith(".csv"):
        return read_csv(spark, path, columns).select(*columns).withColumn("_invalid", F.lit(False))
    item = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if low.endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("v"))
        return _json_rows(lines, columns, item)
    if low.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
        data = F.coalesce(F.get_json_object("v", "$.data"), F.get_json_object("v", "$.comments"), F.col("v"))
        items = whole.select(F.explode(F.from_json(data, "array<variant>")).alias("x")).select(F.to_json("x").alias("v"))
        return _json_rows(items, columns, item)
    raise ValueError(f"{path}: only .csv, .json and .jsonl")


def _json_rows(lines: DataFrame, columns: Sequence[str], item: T.StructType) -> DataFrame:
    kinds = [F.schema_of_variant(F.try_variant_get(F.try_parse_json("v"), f"$.{c}", "variant")) for c in columns]
    wrong = [~F.coalesce(k.isin("STRING", "VOID"), F.lit(True)) for k in kinds]
    bad = F.try_parse_json("v").isNull()
    for w in wrong:
        bad = bad | w
    return lines.select(F.from_json("v", item).alias("r"), F.coalesce(bad, F.lit(True)).alias("_invalid")).select("r.*", "_invalid")


def map_columns(df: DataFrame, mapping: dict[str, str], wanted: Sequence[str] = ("id", "post_id", "text")) -> DataFrame:
    """The wanted columns by a mapping wanted -> source name; a wanted column without mapping is an error."""
    if missing := [c for c in wanted if c not in mapping]:
        raise ValueError(f"no mapping for {missing}")
    return df.select(*[F.col(mapping[c]).alias(c) for c in wanted], *(["_invalid"] if "_invalid" in df.columns else []))


def read_captures(spark: SparkSession, path: str, columns: Sequence[str] = ("id", "post_id", "text"), sources: DataFrame | None = None) -> DataFrame:
    """Rows of all JSON captures of a folder with capture_file, and source_id by a table (file, source_id)."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("capture_file"))
    text = F.regexp_replace("value", "^﻿", "")
    data = F.coalesce(F.get_json_object(text, "$.data"), F.get_json_object(text, "$.comments"), text)
    kind = "array<struct<" + ",".join(f"{c}:string" for c in columns) + ">>"
    rows = whole.select("capture_file", F.explode(F.from_json(data, kind)).alias("r")).select("r.*", "capture_file")
    if sources is None:
        return rows.withColumn("source_id", F.lit(""))
    return rows.join(sources.withColumnRenamed("file", "capture_file"), "capture_file", "left").withColumn("source_id", F.coalesce("source_id", F.lit("")))


DECISION = "array<struct<id:string,seq:bigint,suggested_label:string,review_priority:string,reason:string,action:string>>"


def read_decisions(spark: SparkSession, path: str, base_hash: str) -> DataFrame:
    """The decisions of all batch files of a folder; a batch for another base, or two decisions for an id, are an error."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="batch_*.json")
    batches = whole.select(F.get_json_object("value", "$.base_sha256").alias("base"), F.from_json(F.get_json_object("value", "$.decisions"), DECISION).alias("d"))
    if batches.where(~F.col("base").eqNullSafe(F.lit(base_hash))).limit(1).count():
        raise ValueError("a batch belongs to another base")
    rows = batches.select(F.explode("d").alias("d")).select("d.*")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id has more than one decision")
    return rows


def read_decision_files(spark: SparkSession, path: str) -> int:
    """How many batch files a folder holds."""
    fs, target = _fs(spark, path)
    return sum(1 for f in fs.listStatus(target) if f.getPath().getName().startswith("batch_"))


def literal(spark: SparkSession, text: str) -> DataFrame:
    """One row (id new-1, text)."""
    return spark.createDataFrame([("new-1", text)], "id string, text string")


def read_segmented(spark: SparkSession, path: str, labels: dict[str, int]) -> DataFrame:
    """(segmented_text, label, label_id) of a segmented data set: labels are stripped and in lower case; unknown labels and missing texts are an error."""
    df = read_csv(spark, path, ("segmented_text", "label")).withColumn("label", F.lower(F.trim("label")))
    ids = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    df = df.withColumn("label_id", F.try_element_at(ids, F.col("label")))
    if df.where("label_id IS NULL OR segmented_text IS NULL OR trim(segmented_text) = ''").limit(1).count():
        raise ValueError(f"{path}: unknown labels or missing texts")
    return df


def with_row_number(df: DataFrame, order: Sequence[str | Column], start: int = 1, name: str = "seq") -> DataFrame:
    """Adds the place of each row in an order, by range partitions and their sizes, so that no task holds all rows."""
    from quern.workspace import Workspace

    work = Workspace(df.sparkSession, "rows")
    sorted_df = work.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = sorted_df.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first")).orderBy("_p").collect()  # one row a partition
    before, table = 0, []
    for r in sizes:
        table.append((r["_p"], r["_first"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(table, "_p int, _first bigint, _before bigint")
    return sorted_df.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + start).drop("_p", "_i", "_first", "_before")  # one row a partition


# sinks


def refuse_existing(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise ValueError(f"{path} exists and is not overwritten")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, single: bool = False) -> None:
    """CSV with a header, everything quoted where needed so that read_csv gives it back; an existing path is an error.

    single writes one file, for results that are known to be small.
    """
    out = df.select(*columns) if columns else df
    out = out.coalesce(1) if single else out
    out.write.mode("errorifexists").options(header=True, quote='"', escape='"', emptyValue="", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def replace_with(spark: SparkSession, path: str, write) -> None:
    """Lets ``write`` make a folder beside ``path`` and puts it in its place; what stood there stays until the new one is complete."""
    fs, target = _fs(spark, path)
    made = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:12]}"
    write(made)
    old = f"{made}-old"
    if fs.exists(target):
        fs.rename(target, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, made)[1], target):
        raise ValueError(f"{path} could not be replaced")
    fs.delete(_fs(spark, old)[1], True)


def write_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV file with a byte order mark, for spreadsheets: the columns in order, others are left out, NULL as ''.

    The rows go through the driver one partition at a time; an older file is replaced when the
    new one is complete.
    """
    fs, target = _fs(df.sparkSession, path)
    made = _fs(df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:12]}")[1]
    out, text = fs.create(made, False), io.StringIO()
    rows = csv.writer(text, lineterminator="\n")
    try:
        text.write("\ufeff")
        rows.writerow(columns)
        for n, row in enumerate(df.select(*columns).toLocalIterator()):
            rows.writerow(["" if v is None else v for v in row])
            if n % 1000 == 999:
                out.write(bytearray(text.getvalue().encode()))
                text.seek(0)
                text.truncate()
        out.write(bytearray(text.getvalue().encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(made, target):
        raise ValueError(f"{path} could not be replaced")


def archived_name(path: str, sha256: str) -> str:
    """The name under which an older version of a file is kept: its stem, the start of its hash, its suffix."""
    head, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    kept = f"{stem}_{sha256[:12]}.{suffix}" if dot and stem else f"{name}_{sha256[:12]}"
    return f"{head}/{kept}" if head else kept


def write_json(spark: SparkSession, path: str, value) -> None:
    """A JSON document made on the driver; parents are made, an existing file is an error."""
    fs, target = _fs(spark, path)
    refuse_existing(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("﻿"))


def load_config(path: str) -> dict:
    """A configuration file, YAML (where PyYAML is installed) or JSON; it must be a mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the configuration must be a mapping")
    return value


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], replace: bool = False) -> DataFrame:
    """old and new together, one row a key: old rows win, or new ones with ``replace``.

    Of new rows with one key the last by ``order`` counts with ``replace``, as it would overwrite
    the others, and the first without, as the others would be ignored; ties go by all columns.
    """
    pick = F.max_by if replace else F.min_by
    rest = [c for c in new.columns if c not in key]
    by = F.struct(*order, *[F.col(c).cast("string") for c in rest if c not in order])
    one = new.groupBy(*key).agg(pick(F.struct(*rest), by).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)
    if replace:
        return old.join(one.select(*key), list(key), "left_anti").unionByName(one)
    return old.unionByName(one.join(old.select(*key), list(key), "left_anti"))


# provenance


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values; NULL and '' differ."""
    return F.sha2(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in columns]), 256)


def dataset_hash(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest of a table that doesn't depend on the order of its rows; repeated rows count.

    Rows' digests are added up in four 64-bit lanes, so nothing but sums is gathered.
    """
    cols = list(columns or df.columns)
    h = df.select(row_hash(sorted(cols)).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    r = h.agg(F.count(F.lit(1)).alias("n"), *lanes).first()
    return hashlib.sha256("|".join([*sorted(cols), *map(str, r)]).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def metadata_hash(value) -> str:
    """SHA-256 of a value as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def same_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Whether two tables hold the same rows, each as often."""
    x, y = a.select(*columns), b.select(*columns)
    return not (x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count())


def save_splits(df: DataFrame, path: str, source_hash: str, about: dict) -> dict:
    """Writes rows with their split, one folder a split, and a manifest with counts and hashes; an existing path is an error."""
    spark = df.sparkSession
    refuse_existing(spark, path)
    df.write.partitionBy("split").parquet(f"{path}/rows")
    manifest = about | {"schema_version": 1, "source_sha256": source_hash, "splits": {}}
    saved = spark.read.parquet(f"{path}/rows")
    for name in sorted(r[0] for r in saved.select("split").distinct().collect()):
        part = saved.where(F.col("split") == name)
        manifest["splits"][name] = {"rows": part.count(), "posts": part.select("post_id").distinct().count(), "sha256": dataset_hash(part, [c for c in df.columns if c != "split"])}
    write_json(spark, f"{path}/manifest.json", manifest | {"manifest_sha256": metadata_hash(manifest)})
    return manifest | {"manifest_sha256": metadata_hash(manifest)}


def load_splits(spark: SparkSession, path: str, ids: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The rows and the manifest of saved splits.

    It is an error if the manifest or the rows were changed, a split lacks a label, an id, post or
    text stands in two splits, labels with origins have ones that don't fit, or the ids are not
    those of ``ids`` (id), if that is given.
    """
    from quern.operators.quality import origins_invalid
    from quern.operators.split import check_disjoint

    manifest = read_json(spark, f"{path}/manifest.json")
    own = manifest.pop("manifest_sha256")
    if metadata_hash(manifest) != own:
        raise ValueError("the manifest was changed")
    rows = spark.read.parquet(f"{path}/rows")
    for name, info in manifest["splits"].items():
        if dataset_hash(rows.where(F.col("split") == name), [c for c in rows.columns if c != "split"]) != info["sha256"]:
            raise ValueError(f"the rows of {name} were changed")
    check_disjoint(rows)
    if {"label_source", "annotation_status", "reviewer"} <= set(rows.columns) and origins_invalid(rows).limit(1).count():
        raise ValueError("a label's source and status don't fit")
    if ids is not None and not same_rows(rows.select("id"), ids.select("id"), ["id"]):
        raise ValueError("the ids are not those that were to be split")
    return rows, manifest | {"manifest_sha256": own}
