"""Reading the given tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}  # folders by application


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; naive timestamps become timestamps of the (UTC) session."""
    return _timed(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        path = f"{sf_dir}/[{name[0]}]{name[1:]}.parquet"  # a stream's path is a folder, or a pattern that files match
    files = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    return _timed(files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    made = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table in the shared folder: lineage ends here, and columns are read one by one."""
    folder = shared_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> int:
    """Deletes what queries have left in the shared folder so far, and says how much; for use once their results are written.

    Plans that read it cannot run any more. Only folders that this session has made are touched.
    """
    from .storage import files

    gone = _made.pop(spark.sparkContext.applicationId, [])
    for folder in gone:
        files.delete(spark, folder)
    return len(gone)
