"""Session helpers: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a directory of files) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) a folder of the machine stands in for a missing setting; on a cluster
    that is an error, as executors would not see each other's files.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (jsc := getattr(spark.sparkContext, "_jsc", None)) is not None:
        told = jsc.sc().getCheckpointDir()  # as told to the running context
        named = told.get() if told.isDefined() and _own_dir is None else None
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


_own_dir: str | None = None


class Scratch:
    """Written tables that cut lineage and survive the loss of any executor.

    ``write`` stores a DataFrame as parquet in the shared folder and reads it back; ``drop`` removes
    tables that no later step reads. What is left at the end of the application is removed at exit.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.clear)

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}-{label}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._delete(path)

    def release(self) -> None:
        """Let the driver's cleaner remove the shuffle files of finished steps."""
        try:
            self.spark.sparkContext._jvm.System.gc()
        except Exception:  # noqa: BLE001 - a hint only
            pass

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the application may already be gone
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
