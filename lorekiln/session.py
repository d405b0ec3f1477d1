"""Session helpers: a default session, the shared scratch folder and the workers' import path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorekiln")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Our own folder is only chosen for a local master, where driver and executors are one process.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lorekiln-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no earlier run has used; removed by release()."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


#: Folders that settled() and fresh_path() of this driver have made and nothing has removed yet.
_made: dict[str, SparkSession] = {}


def exists(path: str | None) -> bool:
    """Whether a path of fresh_path() is still kept by this driver."""
    return path in _made


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of any executor.

    The folder lasts until discard() or release(), at the latest until the driver ends.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove the folders of settled tables that nothing will read again."""
    for df in tables:
        for f in df.inputFiles():
            path = next((p for p in _made if f"/{Path(p).name}/" in f), None)
            if path is not None:
                _remove(_made.pop(path), path)


def release(spark: SparkSession) -> int:
    """Remove every folder this driver has settled: call it once the results of its queries are consumed. Returns their number."""
    paths = list(_made)
    for path in paths:
        _remove(spark, path)
        _made.pop(path, None)
    return len(paths)


@atexit.register
def _release_at_end() -> None:
    """What is left goes when the driver ends, as long as its JVM still answers."""
    for path, spark in list(_made.items()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  a stopped session or JVM cannot remove anything any more
            return
