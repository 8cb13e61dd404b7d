"""Session helpers: time zone, and the shared folder for files a job must outlive a task with."""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps are read and printed in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only for local sessions."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        configured = _own_dirs[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/costlens/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote (made by ``new_dir``)."""
    if "/costlens/" not in path:
        raise ValueError(f"not a folder of this library: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fixed_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of a few constant rows, planned as a local relation."""
    names = [part.split()[0] for part in ddl.split(", ")]
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows])
    return spark.createDataFrame(table, ddl)
