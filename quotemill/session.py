"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quotemill", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="quotemill-package-")) / "quotemill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def use_utc(spark: SparkSession) -> None:
    """Timestamps are handled in UTC; the market zone is always converted explicitly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if any."""
    key = "spark.checkpoint.dir"
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def _own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine; only where driver and executors are one process."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    folder = tempfile.mkdtemp(prefix=f"quotemill-{name}-", dir=os.environ.get("TMPDIR"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; a temporary one on a single machine without it."""
    named = _shared_folder(spark)
    if named:
        return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _own_folder(spark, name)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
    temporary one is made on a single machine, and anything else is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(spark) or _own_folder(spark, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table below the shared folder and read that.

    For tables that several steps scan: unlike a checkpoint, each scan reads only its own columns.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
