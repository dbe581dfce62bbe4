"""A store whose cue-keyed logs are bucketed by cue, so that what belongs to a cue lies together.

Attempts, revisions, decisions and deletions of a cue are in the same bucket of every table, and of
the mixed log too. Newest rows, folds and joins by cue read bucket by bucket and exchange nothing.
Folders by project come first, so that a predicate on the project reads only its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store: one task reads a bucket, so that there should be as many as a large job has tasks at once.
BUCKETS = 64


def append_bucketed(rows: DataFrame, table: str, *, cue: str = "cue_id", seq: str = "append_seq", project: str | None = "project_id", buckets: int = BUCKETS, path: str | None = None) -> None:
    """Append rows to a bucketed table of the catalog, made if there is none.

    Rows are dealt to tasks by bucket, so that each append adds one file a project and bucket,
    sorted by cue and number. ``path`` is where a new table's files go (else the warehouse).
    """
    # by the bucket and not the cue: rows that come from a bucketed table would be taken as dealt by cue already, though the scan then drops its buckets
    bucket = F.pmod(F.hash(cue), F.lit(buckets))
    keys = [*([project] if project else []), cue, seq]
    writer = rows.repartition(4 * buckets, bucket).sortWithinPartitions(*keys).write.format("parquet").mode("append").bucketBy(buckets, cue).sortBy(cue, seq)
    writer = writer.partitionBy(project) if project else writer
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table with its buckets known to the planner."""
    return spark.table(table)


def compact(spark: SparkSession, table: str, into: str, **options) -> None:
    """The table's rows with one file for each project and bucket, as the table ``into``."""
    append_bucketed(spark.table(table), into, **options)
