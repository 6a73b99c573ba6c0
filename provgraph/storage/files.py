"""Small files in a folder that the driver and the executors share, through the file system that Spark uses there."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(Exception):
    """The name is taken."""


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, name: str) -> None:
    p, fs = _path(spark, name)
    fs.delete(p, True)


def read_json(spark: SparkSession, name: str):
    p, fs = _path(spark, name)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def create_json(spark: SparkSession, name: str, value) -> None:
    """Makes the file with its whole content at once, or raises Exists and changes nothing.

    The content is written beside it first. On the local file system a hard link then takes the name, elsewhere a rename that does not
    overwrite; both are atomic, so of two writers one gets the name. Stores whose rename is a copy need a lock of their own.
    """
    p, fs = _path(spark, name)
    t, _ = _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    jvm = spark._jvm
    fs.mkdirs(p.getParent())
    out = fs.create(t, False)
    try:
        out.write(json.dumps(value).encode())
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(p), local(t))
        else:
            none = spark._sc._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(t, p, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Exists(name) from None
        raise
    finally:
        fs.delete(t, False)
