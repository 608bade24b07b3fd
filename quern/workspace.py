"""Session helpers and the shared folder for intermediate tables.

Iterative operators cut their lineage by writing small parquet tables into the folder that the
session names in ``spark.checkpoint.dir``; every executor can read them, so they survive the loss
of an executor. Only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}
# Once a table is written nothing reads the shuffle files of its job again.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", name: str = "quern", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="quern-")
    return "file://" + _made[app]


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever the driver was started; once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quern-zip-')}/quern", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)  # the driver serves the file to the executors
    _shipped[app] = made
    atexit.register(shutil.rmtree, Path(made).parent, ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Intermediate tables of one operator run.

    ``save`` writes a table and returns it read back (no lineage), ``drop`` deletes tables that no
    later step reads. The others stay as long as the operator's result may be read: until
    :func:`clear` is called, which a long session does once it has written its results, or until
    the driver's interpreter ends.
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not Workspace._open:
            atexit.register(clear)
        Workspace._open.append(self)

    def save(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        return self.save_counted(df, compression)[0]

    def save_counted(self, df: DataFrame, compression: str = "zstd", **sums) -> tuple[DataFrame, dict]:
        """The table read back, and {"n": rows, name: aggregate...} observed while it was written."""
        self._n += 1
        path = f"{self.path}/t{self._n:04d}"
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items()))
        before = self.spark.conf.get(_DROP_SHUFFLES, None)
        try:
            if before is not None:
                self.spark.conf.set(_DROP_SHUFFLES, "true")
            watched.write.option("compression", compression).parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(_DROP_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes saved tables that no later step reads."""
        for t in tables:
            if t is not None and hasattr(t, "_quern_path"):
                _delete(self.spark, t._quern_path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the session has ended; the cluster cleans its checkpoint folder
            pass


def clear() -> int:
    """Deletes the intermediate tables of all operators run so far; results that were not written can't be read afterwards. Gives the number of runs."""
    done = len(Workspace._open)
    while Workspace._open:
        Workspace._open.pop().close()
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table (file or folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most ``most_rows`` rows; reads no more than that many plus one."""
    return df.limit(most_rows + 1).count() <= most_rows


def maybe_broadcast(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The table with a broadcast hint if it is checked to be small, else unchanged."""
    return F.broadcast(df) if small_enough(df, most_rows) else df
