"""Where intermediate tables go: a shared folder, so that a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:///tmp/checkpoints/orrery"  # for a single machine without spark.checkpoint.dir
_MADE: list[str] = []
ROWS = 1_000_000  # of a partition that is sorted or summed up in memory


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir. On a cluster that must be set: executors don't see each other's own folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> list[str]:
    """The folders that this driver has made and not yet deleted."""
    return list(_MADE)


def release(spark: SparkSession, folders: list[str] | None = None) -> int:
    """Delete those of the folders (None: all that this driver made), and say how many; results that read them must be written before."""
    gone = made() if folders is None else [f for f in folders if f in _MADE]
    for f in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(f)
    return len(gone)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and later plans know its size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shares(df: DataFrame, times: int = 1) -> int:
    """Into how many partitions to deal a table (or so many times its rows), so that a task's share doesn't grow with it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * times // ROWS))
