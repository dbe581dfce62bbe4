"""A table of the newest row of each key that a stream keeps up to date.

A batch rewrites only the buckets that its keys fall into, and which version of each bucket counts
is said by one small manifest a batch, put in place by a rename. So a reader sees whole batches, a
batch that is run again changes nothing, one that broke off is written anew, and the stream itself
keeps no state.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake.operators.evidence import newest


class KeyedTable:
    """The table in ``folder``, which every executor reaches: ``schema`` has the ``key``, the number ``seq`` by which rows of a key are ordered, and what else is kept.

    ``buckets`` is fixed when the table is begun; one task writes a bucket, so there should be
    enough of them for a bucket to fit one. ``kept`` versions stay readable for queries under way.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, *, key: str = "cue_id", seq: str = "append_seq", buckets: int = 64, kept: int = 2):
        self.spark, self.folder, self.schema, self.key, self.seq, self.buckets, self.kept = spark, folder.rstrip("/"), schema, key, seq, buckets, kept
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def batches(self) -> list[int]:
        """Numbers of the batches whose manifests are there, in order."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def versions(self, batch: int | None = None) -> dict[int, int]:
        """Of each bucket that has rows, the batch that wrote it last, as of ``batch`` or now."""
        batch = max(self.batches(), default=None) if batch is None else batch
        if batch is None:
            return {}
        stream = self._files.open(self._path(f"manifest/{batch}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        if told["buckets"] != self.buckets:
            raise ValueError(f"the table has {told['buckets']} buckets")
        return {int(b): v for b, v in told["versions"].items()}

    def _put(self, batch: int, versions: dict[int, int]) -> None:
        waiting, final = self._path(f"manifest/.{batch}.waiting"), self._path(f"manifest/{batch}.json")
        out = self._files.create(waiting, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "versions": versions}).encode()))
        out.close()
        if not self._files.rename(waiting, final):
            raise OSError(f"could not put {final.toString()} in place")

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest row of each key, as of the last whole batch."""
        return self._read(self.versions())

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch; nothing happens if it, or a later one, was taken in before. Older rows than a key has are left out; null keys are one key."""
        done = self.batches()
        if done and batch <= done[-1]:
            return
        columns = [f.name for f in self._read({}).schema]
        fresh = newest(rows.select(*columns), self.key, self.seq).withColumn("bucket", F.pmod(F.hash(self.key), F.lit(self.buckets))).persist()
        try:
            touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
            before = self.versions()
            if touched:
                old = self._read({b: before[b] for b in touched if b in before}).withColumn("bucket", F.pmod(F.hash(self.key), F.lit(self.buckets)))
                merged = newest(old.unionByName(fresh), ["bucket", self.key], self.seq)
                merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={batch}")
            self._put(batch, before | dict.fromkeys(touched, batch))
        finally:
            fresh.unpersist()
        self._clean()

    def _clean(self) -> None:
        """Delete manifests before the last ``kept``, and versions that none of those names."""
        done = self.batches()
        live = {(v, b) for batch in done[-self.kept :] for b, v in self.versions(batch).items()}
        for name in self._names("data"):
            version, own = int(name[2:]), [n for n in self._names(f"data/{name}") if n.startswith("bucket=")]
            dead = [n for n in own if (version, int(n[7:])) not in live]
            if version > done[-1]:  # of a batch under way, or one that broke off
                continue
            for path in [f"data/{name}"] if len(dead) == len(own) else [f"data/{name}/{n}" for n in dead]:
                self._files.delete(self._path(path), True)
        for batch in done[: -self.kept]:
            self._files.delete(self._path(f"manifest/{batch}.json"), False)


def follow(rows: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``table`` up to date with a stream of rows. The query has no state store; the checkpoint and the table belong together."""
    return rows.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
