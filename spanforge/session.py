"""Sessions, table access and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import secrets
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str | None = None, name: str = "spanforge") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a session without that setting, as in tests, gets a folder of its own, and only where the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spanforge-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    folder = "file://" + own
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, *metrics: Column):
    """The rows of ``df`` with its lineage cut: written to the shared folder as Parquet and read again.

    The files outlive the loss of an executor, unlike a local checkpoint.  They lie in a folder of the application,
    so that whoever owns the shared folder can remove them by its id; ``drop_cuts`` does.  With ``metrics``, aggregates that
    are taken while the rows are written, the result is a pair of the rows and a dict of their values.
    """
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return (out, seen.get) if metrics else out


def still_there(cut_rows: DataFrame) -> bool:
    """Whether the files of a cut have not been removed."""
    spark = cut_rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cut_rows.cut_path}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def signature(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """Sizes and times of the files of tables: what changes when a table is written anew."""
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path)] if system.exists(path) else [(name, -1, -1)]
    return tuple(sorted(out))


def drop_cuts(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; results must have been read or written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_local_secret = secrets.token_hex(32)


def secret(spark: SparkSession, purpose: str, lasting: bool = True) -> str:
    """The key of pseudonyms: ``spanforge.secret`` of the session, else SPANFORGE_SECRET; each purpose has one of its own.

    No key is built in.  Where none is set, a local session gets a random one for the life of the process, so that its
    pseudonyms can't be linked or inverted later; on a cluster that is an error, unless the pseudonyms need not be the same in
    another session (``lasting`` false): those get the random key there too, with a warning.
    """
    known = spark.conf.get("spanforge.secret", None) or os.environ.get("SPANFORGE_SECRET")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            if lasting:
                raise ValueError("spanforge.secret must be set")
            warnings.warn(f"spanforge.secret is not set: {purpose} get a random key and hold for this session only", stacklevel=2)
        known = _local_secret
    return f"{purpose}|{known}"
