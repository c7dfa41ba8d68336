"""What the operators need of the session: shared scratch folders and code on the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlspar import session

#: Scratch folders by application, where the session names none.
_own: dict[str, str] = {}
_folders: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset, on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="marlspar-")
        _own[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder."""
    path = f"{scratch_root(spark)}/marlspar/{uuid.uuid4().hex}/{name}"
    _folders.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that read, not what came before.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch folders made so far; call it once the results have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python workers, and bound what they are handed at once.

    Bounds that the session has itself are left as they are.
    """
    own = spark.conf.getAll
    for key, bound in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        if f"spark.sql.execution.arrow.{key}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))
    session.ship(spark)
