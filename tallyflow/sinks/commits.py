"""History that becomes readable by one record, and is compacted under the same list.

Below a job's folder lie its tables, and ``_commits`` with small JSON records:

* a batch's record names the folders that the batch wrote in all its tables. It is written last, by
  renaming a finished file, so a job that dies between two tables leaves nothing that a reader follows;
* a compaction's record names one new folder of one table and day, and the folders that it replaces.

A reader lists the records once and opens exactly the folders that are named and not replaced: it sees a row
in its batch or in the compacted day, never in both and never in neither. Folders without a name are left-overs of
dead jobs. ``vacuum`` removes those and replaced ones after a time that no reader lasts.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.sinks.tables import BATCH_KEYS, BATCHES_PER_GROUP

RECORDS, COMPACTED = "_commits", "_compacted"
ROWS_PER_FILE = 5_000_000
RECORD = T.StructType(
    [
        T.StructField("day", T.StringType()),
        T.StructField("folders", T.ArrayType(T.StringType())),
        T.StructField("replaces", T.ArrayType(T.StringType())),
    ]
)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def _write_record(spark: SparkSession, root: str, name: str, record: dict) -> None:
    """Whole or not at all: readers skip names that begin with a dot."""
    target, files = _path(spark, f"{root}/{RECORDS}/{name}.json")
    draft, _ = _path(spark, f"{root}/{RECORDS}/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray((json.dumps(record) + "\n").encode()))
    out.close()
    if not files.rename(draft, target):
        files.delete(draft, False)
        if not files.exists(target):  # another attempt of the same batch may have been faster
            raise OSError(f"cannot write {target}")


def batch_folder(table: str, writer: str, batch_id: int, day: str) -> str:
    return f"{table}/day={day}/writer={writer}/batchGroup={batch_id // BATCHES_PER_GROUP}/batchId={batch_id}"


def is_committed(spark: SparkSession, root: str, writer: str, batch_id: int) -> bool:
    return _exists(spark, f"{root}/{RECORDS}/{writer}-{batch_id:012d}.json")


def commit_batch(spark: SparkSession, root: str, writer: str, batch_id: int, day: str, tables: list[str]) -> None:
    """Make what a batch wrote in its tables readable, all at once."""
    folders = [batch_folder(t, writer, batch_id, day) for t in tables]
    _write_record(spark, root, f"{writer}-{batch_id:012d}", {"day": day, "folders": folders, "replaces": []})


def _listed(spark: SparkSession, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(day, folder) of all folders that are named and not replaced."""
    if not _exists(spark, f"{root}/{RECORDS}"):
        return spark.createDataFrame([], "day string, folder string")
    records = spark.read.schema(RECORD).json(f"{root}/{RECORDS}")
    if since:
        records = records.filter(F.col("day") >= since)
    if until:
        records = records.filter(F.col("day") <= until)
    gone = F.explode("replaces").alias("folder")  # a compaction stays within its day
    return records.select("day", F.explode("folders").alias("folder")).join(records.select(gone), "folder", "left_anti").select("day", "folder")


def folders_of(spark: SparkSession, root: str, table: str, since: str | None = None, until: str | None = None) -> list[str]:
    """Folders of a table that a reader opens: one per compacted day, one per batch of open days."""
    listed = _listed(spark, root, since, until).filter(F.col("folder").startswith(f"{table}/"))
    return sorted({r["folder"] for r in listed.collect()})


def read_committed(
    spark: SparkSession, root: str, table: str, schema: T.StructType, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Rows of a declared schema with their batch keys. Days (ISO dates, both ends included) choose folders;
    filters on ``day`` prune folders as well."""
    keys = [T.StructField("writer", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("batchGroup", "batchId")]]
    day = T.StructField("day", T.DateType())
    folders = folders_of(spark, root, table, since, until)
    parts = []
    for compacted in (False, True):
        mine = [f"{root}/{f}" for f in folders if f.startswith(f"{table}/{COMPACTED}/") == compacted]
        if mine:
            base = f"{root}/{table}/{COMPACTED}" if compacted else f"{root}/{table}"
            rows = spark.read.schema(T.StructType([*schema.fields, *keys, day])).option("basePath", base).parquet(*mine)
            parts.append(rows.select(*schema.fieldNames(), *BATCH_KEYS))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, day, *keys]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, root: str, table: str, schema: T.StructType, day: str, rows_per_file: int = ROWS_PER_FILE) -> bool:
    """Rewrite a day of a table to few files; False if it is one folder already.

    For days that are closed; a batch that still comes late stays a folder of its own until the next compaction.
    Two compactions of one day at a time are the caller's to avoid.
    """
    replaced = folders_of(spark, root, table, day, day)
    if len(replaced) < 2 and all(COMPACTED in f for f in replaced):
        return False
    rows = read_committed(spark, root, table, schema, day, day).drop("day")
    run = uuid.uuid4().hex
    folder = f"{table}/{COMPACTED}/day={day}/run={run}"
    rows.repartition(max(1, -(-rows.count() // rows_per_file))).write.parquet(f"{root}/{folder}")
    _write_record(spark, root, f"compact-{table}-{day}-{run}", {"day": day, "folders": [folder], "replaces": replaced})
    return True


def compact_closed(spark: SparkSession, root: str, table: str, schema: T.StructType, today: str | None = None) -> list[str]:
    """Compact every day before ``today`` (the last days stay open); returns the days rewritten."""
    today = today or date.today().isoformat()
    listed = _listed(spark, root, until=today).filter((F.col("day") < today) & F.col("folder").startswith(f"{table}/"))
    days = sorted(r["day"] for r in listed.select("day").distinct().collect())
    return [d for d in days if compact(spark, root, table, schema, d)]


def vacuum(spark: SparkSession, root: str, table: str, keep_seconds: float = 7 * 86_400) -> int:
    """Delete folders of a table that no record names, or that were replaced, and are older than ``keep_seconds``.

    Readers and running batches must be younger than that. Returns how many were deleted.
    """
    named = set(folders_of(spark, root, table))
    base, files = _path(spark, f"{root}/{table}")
    deleted = 0
    if not files.exists(base):
        return 0
    for pattern in (f"{root}/{table}/day=*/writer=*/batchGroup=*/batchId=*", f"{root}/{table}/{COMPACTED}/day=*/run=*"):
        found = files.globStatus(_path(spark, pattern)[0]) or []
        for status in found:
            full = status.getPath().toString()
            folder = full[full.index(f"/{table}/day=") + 1 if COMPACTED not in full else full.index(f"/{table}/{COMPACTED}/") + 1 :]
            if folder not in named and status.getModificationTime() < (time.time() - keep_seconds) * 1000:
                files.delete(status.getPath(), True)
                deleted += 1
    return deleted
