"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "incidentia", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC time and adaptive execution; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="incidentia-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor. They stay until someone deletes them;
    jobs that know when they are done use ``Scratch``.
    """
    return _write_and_read(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """The written tables of one job, deleted together at the end of the ``with`` block.

    Nothing that leaves the block may still read them.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
        self._tables = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._tables += 1
        return _write_and_read(df, f"{self._root}/{name}-{self._tables}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        root = self._spark._jvm.org.apache.hadoop.fs.Path(self._root)
        root.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(root, True)


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
