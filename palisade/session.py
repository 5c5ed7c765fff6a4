"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a session of one single process (master ``local`` or ``local[n]``) may leave it unset;
    its own folder is then set once. On any cluster, ``local-cluster`` included, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_TABLE = re.compile(r".+-[0-9a-f]{32}")


def fresh_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{folder or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Cut the lineage through a written table; survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, label: str = "", folder: str | None = None) -> int:
    """Delete what ``materialise`` has left in the shared folder (of one label, or all); for the
    folder's owner, when no frame that reads those tables is needed any more. Returns their number."""
    root = folder or shared_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    found = [s.getPath() for s in files.listStatus(path) if _TABLE.fullmatch(s.getPath().getName())]
    mine = [p for p in found if not label or p.getName().rpartition("-")[0] == label]
    for one in mine:
        files.delete(one, True)
    return len(mine)
