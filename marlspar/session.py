"""Session helpers shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "marlspar") -> SparkSession:
    """A local session with the settings the queries expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARLSPAR_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch roots by application, where the session names none, and the folders made so far.
_roots: dict[str, str] = {}
_folders: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder of spark.checkpoint.dir, or in a local one where that is unset on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _roots.get(app) or _roots.setdefault(app, "file://" + tempfile.mkdtemp(prefix="marlspar-"))
    folder = f"{root.rstrip('/')}/marlspar/{uuid.uuid4().hex}"
    _folders.append(folder)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: a lost executor costs the tasks that read, not what came before."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt out by their keys, before costly work in Python: a short table is one split of one file, and would be one task.

    Call it while rows are short, before what is computed from them.
    """
    return df.repartition(max(2, 2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *[F.xxhash64(k) for k in keys])


def release(spark: SparkSession) -> None:
    """Delete the scratch folders made so far; call it once the results have been written."""
    while _folders:
        delete(spark, _folders.pop())


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder with all that it holds, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="marlspar-code-")), "marlspar_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
