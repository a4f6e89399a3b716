"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "candlewright", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session on one machine gets a temporary folder; on a cluster that is an error, since executors
    would write to disks that others do not see.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="candlewright-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Where this application writes intermediate tables, within the shared folder."""
    return f"{shared_folder(spark)}/candlewright-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; frames built on them can't be read any more. Called when Python exits."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_registered: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    def drop() -> None:
        with suppress(Exception):  # the JVM may be gone
            drop_tables(spark)

    if spark.sparkContext.applicationId not in _registered:
        _registered.add(spark.sparkContext.applicationId)
        atexit.register(drop)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back, its lineage cut.

    Columnar, so that later steps read only what they need; on shared storage, so that a lost
    executor loses nothing. ``drop_tables`` deletes it.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    _drop_at_exit(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
