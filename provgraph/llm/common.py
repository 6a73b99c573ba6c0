"""Shared helpers: the shared scratch folder, written tables, document selection, hash splits."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local[...] session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    binary = any(f.dataType.typeName() == "binary" for f in df.schema)  # long values that hardly repeat: no dictionary
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not binary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def file_system(uri: str):
    """The pyarrow file system of a path in the shared folder, and the path in it; for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.partition("/")[0] else "file://" + uri)


def slices(texts, rows: int = 1000, chars: int = 2_000_000):
    """(start, end) of runs of rows of bounded number and size."""
    lo = size = 0
    for hi, text in enumerate(texts):
        if hi > lo and (hi - lo >= rows or size + len(text) > chars):
            yield lo, hi
            lo, size = hi, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def hash_share(share: float) -> int:
    """The bound under which a 63-bit hash falls with this probability."""
    return min((1 << 63) - 1, int(share * (1 << 63)))


def hashed(*columns) -> Column:
    """A 63-bit hash of columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus), F.lit(-1))
