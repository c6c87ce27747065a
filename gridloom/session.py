"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


#: The temporary folder of each application with a local master and no shared one.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only where ``spark.checkpoint.dir`` is unset, and only for a local master,
    a temporary folder stands in for it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _local[application]
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


_kept: list[str] = []


def kept_dir(spark: SparkSession) -> str:
    """A new folder name for files that a lazy result still reads; ``clean_up`` deletes it."""
    _kept.append(shared_dir(spark))
    return _kept[-1]


def keep(path: str) -> None:
    """Leaves a folder that a lazy result still reads to ``clean_up``."""
    _kept.append(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes the folders of ``kept_dir``, once their results are needed no more."""
    while _kept:
        delete(spark, _kept.pop())


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where: what a loop reads again is made once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
