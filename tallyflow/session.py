"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_MADE: list[str] = []  # tables written by this process


def build_session(app: str = "tallyflow", **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; no master is fixed here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; a cluster must name a
    folder that every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="tallyflow-")
    return _OWN_FOLDER[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written to the shared folder inside the block are deleted at its end.

    For jobs that never end: nothing made inside may be read after the block.
    """
    before = list(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _MADE.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a re-run, and a
    frame used several times is computed once.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
