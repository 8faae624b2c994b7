"""Session construction and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster may deploy it with --py-files instead.

    Lowers the session's limits of Arrow batches to BATCH where they are higher: plans are run after they are built, so they can't be set for one of them.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # A batch is held by the JVM and by the worker; rows here are whole texts.
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Rows and bytes of a batch for Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def get_spark(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; a cluster's own settings win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="weftgraph-"))
    return _FALLBACK[0]


_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Removes what this application wrote to the shared folder, while its JVM is still there."""
    for spark, base in _LEFT:
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for folder in _FALLBACK:
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


#: Removes the shuffle files of a query as it ends; else they stay until the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts lineage and survives the loss of executors, which cached
    blocks and local checkpoints don't. ``drop`` removes tables that no later plan reads;
    the rest goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str = "scratch", codec: str | None = None):
        self.spark, self.codec = spark, codec
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _LEFT.append((spark, self.base))
        ship(spark)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back. The shuffle files of writing it go with the write: nothing reads them again."""
        self._count += 1
        path = f"{self.base}/t{self._count}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=self.codec)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._weft_path)
            path.getFileSystem(conf).delete(path, True)


#: Rows that are broadcast to what they are joined with; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is short."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def local_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
