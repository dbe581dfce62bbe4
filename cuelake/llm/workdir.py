"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A session of one machine may have none; it gets a temporary folder. On a cluster that is an
    error, since each executor would write to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cuelake-"))


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches hold ``rows`` rows at most in this session from now on, so that workers stay small with whole texts.

    Spark has this as a setting of the session only; plans that are made later follow it too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


class Scratch:
    """A folder of one run; its tables cut lineage and survive the loss of executors.

    As a context it deletes at its end what no frame given to ``keep`` reads. Those tables, and all
    of a run that failed, go when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        self.needed: set[str] = set()
        self._file_system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._file_system.deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def path(self, name: str) -> str:
        self.saved.append(f"{self.root}/{len(self.saved) + 1:03d}-{name}")
        return self.saved[-1]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back; shuffle files that nothing refers to can go then."""
        path = self.path(name)
        df.write.parquet(path)
        gc.collect()
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            self._file_system.delete(self._path(df._scratch_path), True)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``; the tables it reads stay."""
        files = df.inputFiles()
        self.needed |= {p for p in self.saved if any(f"/{p.split('/')[-2]}/{p.split('/')[-1]}/" in f for f in files)}
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for p in self.saved:
                if p not in self.needed:
                    self._file_system.delete(self._path(p), True)
