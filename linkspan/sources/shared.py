"""Tables in the folder that all executors share, and the code that they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: The folder of each session's tables, by application and root.
_FOLDERS: dict[tuple[str, str], str] = {}


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's tables below spark.checkpoint.dir; it goes when the
    session's JVM ends, or with `cleanup`. Where the setting is missing, one on this machine
    is set if all of Spark runs on it; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='linkspan-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        path, files = _file_system(spark, root)
        files.deleteOnExit(path)
    key = (spark.sparkContext.applicationId, root)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{root.rstrip('/')}/linkspan-{uuid.uuid4().hex}"
        path, files = _file_system(spark, _FOLDERS[key])
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _FOLDERS[key]


def cleanup(spark: SparkSession) -> None:
    """Delete all tables of this session; frames that read them can't be used any more."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _FOLDERS if k[0] == app]:
        delete(spark, _FOLDERS.pop(key))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the run's folder: lineage ends here, and a lost executor
    costs a reread rather than a recomputation."""
    spark = df.sparkSession
    ship(spark)
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the table that `written` returned, once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: a zip of it goes to every executor, once
    for each session. The driver serves the zip as long as it lives."""
    context = spark.sparkContext
    if getattr(context, "_linkspan_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="linkspan-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "linkspan.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    context._linkspan_shipped = True
