"""Session helpers: one place for the settings every job in this package relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on. AQE re-plans joins from runtime sizes (the
# size check behind every join we do not hint), coalesces small shuffle
# partitions and splits skewed ones; ANSI mode is kept on and the code uses
# try_* functions where pandas would produce NaN/inf.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "wavepanel",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    cluster's own settings win, AQE sizes the partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if _context(spark) is not None:
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a folder that all its machines share.  Only a session
    whose tasks run in the driver's own process (master ``local``) gets a
    temporary folder when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = sc.master if sc is not None else ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wavepanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None for a remote session)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def application_key(spark: SparkSession) -> str:
    """Identifier of the running application (falls back to the session id)."""
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return getattr(spark, "session_id", None) or str(id(spark))


def stored_path(spark: SparkSession, name: str | None = None) -> str:
    """A new path for a stored table of this application, under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "stored", application_key(spark), f"{name or 'table'}-{uuid.uuid4().hex[:8]}")


def store_table(df: DataFrame, name: str | None = None, partition_by: list[str] | None = None) -> str:
    """Write `df` as Parquet under the shared checkpoint folder; return the path."""
    path = stored_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def materialize(df: DataFrame, name: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing `df` as a Parquet table under the shared folder
    named by `spark.checkpoint.dir` and returning a scan of it.

    Use for a result that several later jobs read (the cleaned panel).  The
    files survive the loss of any executor (unlike cached or locally
    checkpointed data), and unlike an RDD checkpoint the stored table keeps
    column pruning, filter pushdown and partition pruning for its readers.
    File sizes follow AQE's partition coalescing of the last stage.
    """
    return df.sparkSession.read.parquet(store_table(df, name, partition_by))


def _folder(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a folder, whatever its store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables this application has stored (call it when the work is done)."""
    if _context(spark) is not None:
        fs, p = _folder(spark, os.path.join(ensure_checkpoint_dir(spark), "stored", application_key(spark)))
        fs.delete(p, True)


def input_version(spark: SparkSession, path: str) -> str:
    """What tells one state of the tables under `path` from another: names,
    lengths and modification times of its entries and of the files in them."""
    if _context(spark) is None:
        return ""
    fs, p = _folder(spark, path)
    seen = []
    for entry in fs.listStatus(p):
        for f in ([entry] if entry.isFile() else fs.listStatus(entry.getPath())):
            seen.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return str(hash(tuple(sorted(seen))))


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
