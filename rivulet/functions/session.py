"""Session plumbing: scratch tables in the shared folder and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where the session leaves Spark's own 10,000: a batch of long texts stays small.
ARROW_ROWS = 1_000
_SHIPPED: set[str] = set()
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary folder only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="rivulet-")
    return "file://" + _OWN_DIR[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rivulet-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, rows: int | None = None, each: int = 20_000) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read back: a cut of lineage that survives lost executors.

    Where a bound of its rows is known, a small table goes into few files: one for every ``each`` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    files = None if rows is None else rows // each + 1
    if files is not None and files < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files behind a table from :func:`stored`, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Makes the package importable in every Python worker, once per application, and Arrow batches small in the session."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(ARROW_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if ".zip" not in str(root):
        target = Path(tempfile.mkdtemp(prefix="rivulet-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join(root.name, p.relative_to(root)))
        sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
